"""Calls on batches of like size: results in their rows, little padding, failures alone."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import inference


def test_batches_hold_their_budget():
    r = random.Random(1)
    sizes = [r.choice([0, 1, 5, 64, 65, 300, 5000]) for _ in range(400)]
    cut = inference.cut_by_size(sizes, 4096, 64, 50)
    assert sorted(i for b in cut for i in b) == [i for i, n in enumerate(sizes) if n]
    assert all(len(b) == 1 or (len(b) <= 50 and len(b) * -(-max(sizes[i] for i in b) // 64) * 64 <= 4096) for b in cut)
    assert inference.cut_by_size([], 10, 4, 5) == []


def test_rows_come_back_with_their_results(spark):
    r = random.Random(2)
    rows = [(i, "w" * r.randrange(1, 2000)) for i in range(900)] + [(1000, None), (1001, ""), (1002, "bad" * 30), (1003, "w" * 70000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, t string").withColumn("result", F.lit(7)).withColumn("error", F.lit("clash"))

    def model(texts):
        assert all(texts) and (len(texts) == 1 or max(map(len, texts)) * len(texts) <= 1 << 16)
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [len(t) for t in texts]

    got = {x.id: x for x in inference.batched(df, "t", model, ["id"], kind="int", window=300).collect()}
    assert len(got) == 904
    for i, t in rows:
        want = None if not t or "bad" in t else len(t)
        assert got[i].result == want and (got[i].error is not None) == (i == 1002)
    sent = [(len(t), got[i].padded) for i, t in rows if t]
    assert sum(n for n, _ in sent) / sum(p for _, p in sent) > 0.75  # under a quarter of what is sent is padding
    whole = max(n for n, _ in sent if n < 2000)
    assert sum(n for n, _ in sent if n < 2000) / (whole * len([1 for n, _ in sent if n < 2000])) < 0.55  # without sorting by size nearly half would be


def test_a_model_that_gives_too_few_results(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").coalesce(1)
    got = sorted((x.id, x.result) for x in inference.batched(df, "t", lambda texts: texts[:1], ["id"]).collect())
    assert got == [(1, "a"), (2, "b")]
    assert inference.batched(df.limit(0), "t", lambda texts: texts, ["id"], kind="array<float>").count() == 0
