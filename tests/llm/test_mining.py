"""Hard negatives against a loop over all rows, and the bounds that the filter rests on."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import grid, mining
from tests.llm.test_pair_operators import broadcast_copies


def by_hand(rows, positives, negatives, low, high):
    first = {}
    for i, label, v in sorted((r for r in rows), key=lambda r: (r[0], r[1], r[2])):
        first.setdefault(i, (label, v))
    out = []
    for a, (label, v) in first.items():
        if a % 5:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, name) for i, name, w in rows if i != a and len(w) == len(v)]
        for p, pid, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)[:negatives]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("seed,scale,low,high", [(1, 3, 50, 95), (2, 200, 0, 100), (3, 10**6, 80, 99), (4, 1, -50, 95)])
def test_mining_against_a_loop(spark, monkeypatch, seed, scale, low, high):
    monkeypatch.setattr(mining, "LEAST", 64)
    monkeypatch.setattr(mining, "MOST", 64)
    monkeypatch.setattr(mining, "ANCHORS", 7)
    r = random.Random(seed)
    rows = [(i, r.choice("abc"), [r.randrange(-scale, scale + 1) + scale // 2 for _ in range(7)]) for i in range(260)]
    rows += [(300 + i, "a", rows[10][2]) for i in range(20)]  # equal vectors
    rows += [(10, "b", [scale] * 7), (11, "c", [scale] * 7)]  # ids that occur twice
    rows += [(400 + i, r.choice("ab"), [r.randrange(9), r.randrange(9)]) for i in range(30)]  # another width, without codebooks
    odd = [(None, "a", [1] * 7), (500, None, [1] * 7), (505, "a", None), (510, "a", [1] * 6 + [None]), (515, "a", [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label string, v array<long>").withColumn("score", F.lit("clash")).withColumn("place", F.lit(0))
    got = mining.mine(df, F.col("vec_id") % 5 == 0, "vec_id", "label", "v", 5, 3, low, high)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 5, 3, low, high)


def test_mining_of_nothing_and_of_few(spark):
    df = spark.createDataFrame([(5, "a", [1, 1]), (6, "a", [2, 2]), (7, "b", [1, 1])], "vec_id long, label string, v array<long>")
    assert mining.mine(df.limit(0), F.col("vec_id") % 5 == 0, "vec_id", "label", "v").count() == 0
    assert [tuple(x) for x in mining.mine(df, F.col("vec_id") % 5 == 0, "vec_id", "label", "v").collect()] == [(5, 6, 1, 7, 4, 2)]
    assert mining.mine(df, F.lit(False), "vec_id", "label", "v").count() == 0


def test_scores_lie_within_their_bounds():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-128, 128, (500, 9))
    books = mining.Codebooks(9, np.stack([mining.centroids(p) for p in mining.Codebooks(9, np.zeros((5, mining.CODES, mining.SPAN))).parts(vectors[:300].astype(float))]))
    codes, rest = books.encode(vectors.astype(float))
    row = {"n": 500, "width": 9, "kind": 0, "ids": np.arange(500).astype("<i8").tobytes(), "codes": codes.tobytes(), "rest": rest.tobytes(), "vectors": vectors.astype("<i2").tobytes(), "names": ["a"], "ends": [500]}
    block = mining.Block(row, books)
    for v in vectors[::25]:
        low, high = block.bounds(v, 0, 500)
        true = vectors @ v
        assert (low <= true).all() and (true <= high).all()
        assert np.mean(high - low) < np.ptp(true) / 4  # the bounds tell rows apart


def test_mining_gathers_no_copies_of_blocks_at_the_driver(spark, monkeypatch):
    """The scans of blocks beside anchors, which are small by Spark's estimates, may not be planned as a broadcast of what is repeated."""
    for name in ("LEAST", "MOST"):
        monkeypatch.setattr(mining, name, 64)
    monkeypatch.setattr(mining, "ANCHORS", 7)
    monkeypatch.setattr(grid, "KEPT", 500)
    monkeypatch.setattr(grid, "PASSED", 1000)
    r = random.Random(9)
    rows = [(i, r.choice("abc"), [r.randrange(-50, 90) for _ in range(7)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label string, v array<long>")
    got = mining.mine(df, F.col("vec_id") % 5 == 0, "vec_id", "label", "v", 5, 3, 50, 95)
    assert not broadcast_copies(got)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 5, 3, 50, 95)
