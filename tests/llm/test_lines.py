"""Line deduplication against a loop, after insertions, deletions and compaction; the cuckoo filter by itself."""

from __future__ import annotations

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import lines


def by_hand(held, rows, least=3, shortest=20):
    """held: the rows in the store; gives (id, kept) of rows, sorted."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, text in held:
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest:
                holders[key(line)].add(-(10**9) if i is None else i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        stay = [x for x in own if len(holders[key(x)]) < least or max(holders[key(x)]) == (-(10**9) if i is None else i)]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def got(store, df):
    return sorted(((r.doc_id, r._n_lines, r._n_dropped, r._kept) for r in store.strip(df).collect()), key=str)


def corpus(r, ids):
    shared = [f"  Shared line number {i} that repeats \t" for i in range(12)] + ["short", "Été à la plage, 20", "Été à la plage, 2", "X" * 30000]
    return [(i, "\n".join(r.choice([r.choice(shared), r.choice(shared).upper(), f"line of document {i} {r.random()}", "", "\x0b " + r.choice(shared)]) for _ in range(r.randrange(1, 9)))) for i in ids]


def test_filter_finds_what_it_holds_and_forgets_what_goes():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 20000)
    same = np.repeat(keys[:1], 30)  # one fingerprint more often than its buckets have room
    f = lines.Cuckoo.sized(len(keys))
    f.add(np.concatenate([keys, same]))
    assert f.contains(keys).all() and len(f.stash) < 50
    f = lines.Cuckoo.read(f.slots.astype("<u2").tobytes(), f.stash.tolist())
    f.remove(np.concatenate([keys[1:10000], same]))
    assert f.contains(keys[10000:]).all() and f.contains(keys[:1]).all()
    assert f.contains(keys[1:10000]).mean() < 0.01 and f.contains(rng.integers(-(2**63), 2**63 - 1, 50000)).mean() < 0.01
    f.remove(np.concatenate([keys[:1], keys[10000:]]))
    assert not f.slots.any() and not len(f.stash)
    crowded = lines.Cuckoo(np.zeros((4, 4), dtype=np.uint16), np.zeros(0, dtype=np.int64))
    crowded.add(keys[:100])  # more than there are slots
    assert crowded.contains(keys[:100]).all()
    crowded.remove(keys[:50])
    assert crowded.contains(keys[50:100]).all()


@pytest.mark.parametrize("sent", [lines.SENT, -1])
def test_insertions_and_deletions_leave_what_the_rest_would_give(spark, monkeypatch, sent):
    monkeypatch.setattr(lines, "SHARD", 4)
    monkeypatch.setattr(lines, "SENT", sent)
    r = random.Random(7)
    a, b, c = corpus(r, range(40)), corpus(r, range(100, 140)), corpus(r, [3, 4, 200])  # c: new keys under ids that are there
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("h1", F.lit(1))
    store = lines.LineStore.new(spark)
    assert got(store, frame(a)) == by_hand([], a)
    store.insert(frame(a))
    assert got(store, frame(a)) == by_hand(a, a)
    first = sorted(map(tuple, store.refs().select("h1", "h2", "n", "last").collect()))
    store.insert(frame(b))
    assert got(store, frame(a + b)) == by_hand(a + b, a + b)
    store.insert(frame(c))
    assert got(store, frame(a + b)) == by_hand(a + b + c, a + b)
    gone = [i for i, _ in b] + [3, 4, 200, 999]
    store.delete(spark.createDataFrame([(i,) for i in [*gone, None]], "doc_id long"))
    left = [x for x in a if x[0] not in gone]
    assert got(store, frame(a + b)) == by_hand(left, a + b)
    store.insert(frame([x for x in a if x[0] in gone]))
    assert sorted(map(tuple, store.refs().select("h1", "h2", "n", "last").collect())) == first  # as if b and c had never been
    held, segments = store.refs().where("n >= 3").collect(), [lines.Cuckoo.read(f.slots, f.stash) for f in store.filters().collect()]
    assert sum(int((s.slots != 0).sum()) + len(s.stash) for s in segments) == len(held)  # no fingerprint is left behind
    store.compact()
    assert got(store, frame(a + b)) == by_hand(a, a + b)
    assert got(lines.LineStore(spark, store.root), frame(a)) == by_hand(a, a)  # all state is in files


def test_a_change_that_died_is_not_seen(spark, monkeypatch):
    a = [(i, "the same line of over twenty\nmine " + str(i)) for i in range(5)]
    store, df = lines.LineStore.new(spark), spark.createDataFrame(a, "doc_id long, text string")
    store.insert(df)

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(lines.LineStore, "_commit", dies)
        with pytest.raises(RuntimeError):
            store.delete(df.where("doc_id > 1"))
    assert got(store, df) == by_hand(a, a)
    store.delete(df.where("doc_id > 1"))
    assert got(store, df) == by_hand(a[:2], a)


def test_nulls_repeats_and_nothing(spark):
    same = "A line that stands in all of them"
    rows = [(1, same), (1, same + "\n" + same), (2, None), (2, ""), (None, same), (None, same + "\nrest"), (3, same.upper() + " \n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store = lines.LineStore.new(spark)
    store.insert(df)
    assert got(store, df) == by_hand(rows, rows)  # documents null, 1 and 3 hold it
    store = lines.LineStore.new(spark)
    store.insert(df.where("doc_id <> 3"))
    assert [x[2] for x in got(store, df)] == [0] * 7  # two documents only
    empty = lines.LineStore.new(spark)
    empty.insert(df.limit(0))
    assert empty.strip(df.limit(0)).count() == 0 and empty.strip(df).count() == 7


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    """What a task holds of texts doesn't grow with their length times the rows of a batch."""
    lines.LineStore.new(spark).insert(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    docs = spark.range(300, numPartitions=1).selectExpr("id as doc_id", "repeat(cast(id % 10 as string), 100000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64()), pa.array([len(batch)], pa.int64())], ["bytes", "rows"])

    got = docs.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r.rows for r in got) == 300
    assert max(r.bytes for r in got) < 8 << 20
