"""Streams with keyed state: over several batches and a restart they give what a fold over all events gives."""

from __future__ import annotations

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.streaming import stateful

T0 = datetime.datetime(2024, 1, 1)


def written(spark, rows, schema, folder, cuts):
    """Rows as files of their own, in order."""
    edges = [0, *cuts, len(rows)]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{folder}/part={i:03d}")
        time.sleep(0.01)


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def folded(events):
    state, out = {}, []
    for key, to, at, seq, progress in sorted(events, key=lambda e: (e[2], e[3])):
        now, held = state.get(key, ("", 0))
        if to in stateful.LEGAL[now]:
            p = 100 if to == "done" else min(100, max(0, progress or 0))
            state[key] = (to, max(held, p) if to == now else p)
            out.append((seq, now, to, *state[key], None))
        else:
            out.append((seq, now, to, now, held, f"{now or 'new'} to {to}"))
    return sorted(out)


@pytest.mark.parametrize("cuts", [[], [40, 90, 91]])
def test_state_machine_is_a_fold_by_time(spark, tmp_path, cuts):
    r, schema = random.Random(5), "key string, to string, at timestamp, seq long, progress int"
    events = [(r.choice("abcd"), r.choice(["pending", "running", "running", "done", "failed"]), T0 + datetime.timedelta(seconds=i // 3), i, r.choice([None, -5, 10, 60, 300])) for i in range(150)]
    if cuts:  # a batch's rows come in any order, batches in order of time
        for a, b in zip([0, *cuts], [*cuts, 150]):
            some = events[a:b]
            r.shuffle(some)
            events[a:b] = some
    src, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    run = lambda: stateful.start(stateful.transitions(stream(spark, schema, src), "key", "to", "at", "seq", F.col("progress")), out, marks).awaitTermination()
    written(spark, events[: cuts[-1]] if cuts else events, schema, src, cuts[:-1])
    run()
    if cuts:
        spark.createDataFrame(events[cuts[-1] :], schema).coalesce(1).write.parquet(f"{src}/part=900")
        run()  # started again from its checkpoint
    got = sorted((x.seq, x["from"], x.to, x.state, x.progress, x.refused) for x in spark.read.parquet(out).collect())
    assert got == folded(events)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != stateful.ROCKS


def test_late_events_are_refused():
    state, refused = stateful.after(("running", 50, T0), "done", None, T0 - datetime.timedelta(seconds=1), stateful.LEGAL)
    assert state == ("running", 50, T0) and refused == "late"
    assert stateful.after(("running", 50, T0), "running", 20, T0, stateful.LEGAL)[0] == ("running", 50, T0)


@pytest.mark.parametrize("cuts", [[], [3, 10, 30]])
def test_barrier_opens_once_whatever_comes_twice(spark, tmp_path, cuts):
    r, schema = random.Random(6), "key string, part long, total long"
    rows = [(f"d{d}", p, 6 if p % 2 else None) for d in range(8) for p in range(6) if (d, p) != (3, 4)]  # d3 lacks a part
    rows += [x for x in rows if r.random() < 0.5]
    r.shuffle(rows)
    src, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    written(spark, rows, schema, src, cuts)
    run = lambda: stateful.start(stateful.complete(stream(spark, schema, src), "key", "part", "total"), out, marks).awaitTermination()
    run()
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/part=900")  # all again
    run()
    assert sorted((x.key, x.total) for x in spark.read.parquet(out).collect()) == [(f"d{d}", 6) for d in range(8) if d != 3]
    spark.createDataFrame([("d3", 4, None)], schema).coalesce(1).write.parquet(f"{src}/part=901")
    run()
    assert sorted(x.key for x in spark.read.parquet(out).collect()) == [f"d{d}" for d in range(8)]


def test_work_is_retried_and_dies_once(spark, tmp_path):
    tries, schema = str(tmp_path / "tries"), "key string, payload string"

    def work(payload: str) -> str:
        with open(tries, "a") as f:
            f.write(payload + "\n")
        with open(tries) as f:
            n = f.read().split("\n").count(payload)
        if payload.startswith("bad") or (payload == "shaky" and n < 3):
            raise ValueError(payload)
        return payload.upper()

    src, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    rows = [("a", "good"), ("b", "bad one"), ("c", "shaky"), ("a", "good"), (None, "lost")]
    written(spark, rows, schema, src, [])
    query = stateful.start(stateful.worked(stream(spark, schema, src), "key", "payload", work, retries=3, first_ms=50, most_ms=400), out, marks, every="100 milliseconds")
    try:
        spark.createDataFrame([("b", "bad one"), ("a", "good")], schema).coalesce(1).write.parquet(f"{src}/part=900")  # delivered again
        for _ in range(120):
            time.sleep(0.5)
            try:
                if len({x.key for x in spark.read.parquet(out).collect()}) == 3:
                    break
            except Exception:  # nothing written yet
                continue
        time.sleep(2)
    finally:
        query.stop()
    got = sorted((x.key, x.outcome, x.attempts, x.result, x.error) for x in spark.read.parquet(out).collect())
    assert got == [("a", "done", 1, "GOOD", None), ("b", "dead", 4, None, "ValueError: bad one"), ("c", "done", 3, "SHAKY", None)]


def test_sessions_end_after_a_gap(spark, tmp_path):
    from tessera.streaming import status

    schema = "user string, at timestamp"
    rows = [("a", T0 + datetime.timedelta(minutes=m)) for m in (0, 3, 20, 21, 90)] + [("b", T0 + datetime.timedelta(minutes=m)) for m in (1, 200)]
    written(spark, rows, schema, str(tmp_path / "in"), [])
    query = status.sessions(stream(spark, schema, str(tmp_path / "in")), "at", "1 minute", "10 minutes", "user").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.user, r.start, r.n) for r in spark.table("sessions").collect())
    assert got == [("a", T0, 2), ("a", T0 + datetime.timedelta(minutes=20), 2), ("a", T0 + datetime.timedelta(minutes=90), 1), ("b", T0 + datetime.timedelta(minutes=1), 1)]  # the last is still open
