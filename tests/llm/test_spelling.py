"""Spelling variants against all pairs of words; the wavelet tree by itself."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling


def one_apart(s: str, t: str) -> bool:
    if len(s) > len(t):
        s, t = t, s
    if len(s) == len(t):
        return sum(x != y for x, y in zip(s, t)) == 1
    return len(t) == len(s) + 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def by_hand(counts: dict[str, int], ratio: int = 5):
    near = {w: [v for v in counts if v != w and one_apart(w, v)] for w in counts}
    form = {}
    for w, other in near.items():
        best = min(other, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], None if form[w] is None else counts[form[w]], root))
    return sorted(out)


def test_wavelet_tree_reports_what_lies_in_both_intervals():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64, 200):
        values = rng.permutation(n)
        low, past = np.sort(rng.integers(0, n + 1, (2, 300)), axis=0)
        least, most = np.sort(rng.integers(0, n + 1, (2, 300)), axis=0)
        query, value = spelling.WaveletTree(values).report(low, past, least, most)
        assert sorted(zip(query.tolist(), value.tolist())) == sorted((q, int(v)) for q in range(300) for v in values[low[q] : past[q]] if least[q] <= v < most[q])


@pytest.mark.parametrize("crowd,shard,letters,seed", [(1 << 14, 1 << 18, "abé", 1), (8, 200, "ab", 2), (1, 40, "ÿz×", 3)])
def test_variants_against_all_pairs(spark, monkeypatch, crowd, shard, letters, seed):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "SHARD", shard)
    r = random.Random(seed)
    counts = {"".join(r.choice(letters) for _ in range(r.choice((1, 2, 6, 6, 7, 8, 9)))): 5 ** r.randrange(6) for _ in range(300)}
    counts |= {"a" * 400: 7, "a" * 401: 70, "a" * 402: 700, "a" * 200 + "b" + "a" * 200: 3, "b" + "a" * 400: 9}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(df).collect())) == by_hand(counts)


def test_words_are_counted_and_shortened(spark):
    r = random.Random(9)
    rows = [(i % 40, " ".join(r.choice(["Naïveté", "naÏveté", "ORDINARY", "ordinary", "日本語", "İstanbul", "a×b÷cde", "short", "sixsix", "don't", "midĀdle", "Éclairs"]) for _ in range(200))) for i in range(60)]
    rows += [(None, "ordinary ordinary"), (1000, None), (1001, ""), (1002, "x" * 70000)]
    want: collections.Counter = collections.Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if own is None else own}:{word}".encode())
            word = word if h % 7 else word[: h % len(word)] + word[h % len(word) + 1 :]
            want[word] += len(word) >= 6
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    assert dict(map(tuple, spelling.count_words(df, "doc_id", "text", every=7).collect())) == {w: n for w, n in want.items() if n}
    assert spelling.count_words(df.limit(0), "doc_id", "text").count() == 0
    whole = dict(map(tuple, spelling.count_words(df, "doc_id", "text").collect()))
    assert whole["ordinary"] == sum((t or "").lower().split().count("ordinary") for _, t in rows) and "naïveté" in whole and "naÏveté" in whole


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert [tuple(x) for x in spelling.variants(spark.createDataFrame([("word", 5)], "word string, n long")).collect()] == [("word", 5, 0, None, None, "word")]
