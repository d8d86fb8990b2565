"""Neighbours, top-k, the Jaccard join and repeated strings against brute force; the pipeline on a small corpus."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, forest, grid, jaccard, substrings, suffix, topk


def vectors(spark, n=600, width=16, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(width).astype(np.float32)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)]  # many copies of one vector
    rows += [(9001, None), (9002, [0.0] * width), (9003, [float("nan")] * width), (9004, [1.0] * (width - 1) + [None]), (9005, [float("inf")] * width), (9006, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))


def test_neighbours_find_nearly_all(spark):
    rows, df = vectors(spark)
    got = collections.defaultdict(list)
    for r in forest.search(df, F.col("vec_id") % 20 == 0, 5, "vec_id", "embedding", crowded=2).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v)) for i, v in rows if i < 9000]
    hits = total = 0
    for i, q in good:
        if i % 20 == 0:
            want = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in good if j != i)[:5]
            found = [x[1:] for x in sorted(got[i])]
            assert [r for r, *_ in sorted(got[i])] == [1, 2, 3, 4, 5] and found == sorted(found, key=lambda x: (x[1], x[0]))
            hits += len({j for _, j in want} & {j for j, _ in found})
            total += 5
    assert hits / total >= 0.9 and set(got) == {i for i, _ in good if i % 20 == 0}
    copies = [x[1] for x in sorted(got[620])]
    assert copies == [7, 600, 601, 602, 603]  # ties go to smaller ids, and copies hide nobody


def test_neighbours_as_registered_against_all_distances(spark):
    from tessera.llm.queries import op2_neighbours

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = collections.defaultdict(set)
    for r in op2_neighbours(spark, "/root/testdata/sf0.01").collect():
        assert r.score == pytest.approx(np.sqrt(((x[ids == r.query_id][0] - x[ids == r.vec_id][0]) ** 2).sum()), abs=1e-12)
        got[r.query_id].add(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 100 == 0):
        apart = np.where(ids == ids[i], np.inf, ((x - x[i]) ** 2).sum(axis=1))
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, apart))[:10]].tolist()))
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_neighbours_beyond_a_repeated_row(spark):
    rows = [(5, [1.0, 0.0])] * 20 + [(i, [1.0, 0.0]) for i in (6, 7, 8, 9)] + [(100, [1.0, 0.1])] + [(i, [9.0, float(i)]) for i in range(20, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.rank, r.vec_id) for r in forest.search(df, F.col("vec_id") == 100, 6, "vec_id", "embedding", share=1.0).collect())
    assert [i for _, i in got[:5]] == [5, 6, 7, 8, 9]


def test_neighbours_of_few(spark):
    _, df = vectors(spark, n=10)
    few = df.where("vec_id < 3")
    assert forest.search(few, F.col("vec_id") == 0, 5, "vec_id", "embedding").count() == 2
    assert forest.search(few.limit(0), F.col("vec_id") == 0, 5, "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 8, 11, 16, 20, 40, 64])
def test_neighbours_of_small_tables_are_all_found(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in forest.search(df, F.col("vec_id") < 2, 10, "vec_id", "embedding").orderBy("query_id", "rank").collect()]
    want = []
    for q in range(min(2, n)):
        apart = ((x - x[q]) ** 2).sum(axis=1)
        want += [(q, int(j)) for j in np.argsort(apart, kind="stable") if j != q][:10]
    assert got == want


def test_walks_of_all_small_sizes_give_enough_and_nearly_the_nearest():
    hits = total = 0
    for n in range(1, 201):
        x = np.random.default_rng(n).standard_normal((n, 64))
        trees = forest.grow(x, 16, 512)
        leaves, sizes = trees.leaves(x), np.zeros((16, 1 << trees.depth), dtype=np.int64)
        for t in range(16):
            np.add.at(sizes[t], leaves[:, t], 1)
        found = {i for t, leaf in trees.visits(x[0], sizes, max(1024, int(0.75 * n)), 11) for i in np.flatnonzero(leaves[:, t] == leaf).tolist()} - {0}
        assert len(found) >= min(10, n - 1)
        near = [int(j) for j in np.argsort(((x - x[0]) ** 2).sum(axis=1), kind="stable") if j != 0][:10]
        hits, total = hits + len(found & set(near)), total + len(near)
    assert hits / total > 0.97


def test_top_k_is_exact(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([0, 0, 0, r.randrange(-9, 9)]) for _ in range(12)]) for i in range(400)] + [(500, None), (501, [1, None]), (502, [1, 2]), (520, [10**9] * 12), (40, [3] * 12)] + [(77, [5] * 12)] * 3
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("rank", F.lit(0))
    got = collections.defaultdict(list)
    for x in topk.search(df, F.col("vec_id") % 20 == 0, 7, "vec_id", "v").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    first = {}
    for i, v in rows:
        if v and None not in v and i % 20 == 0 and (i not in first or v < first[i]):
            first[i] = v
    for i, q in first.items():
        best = {}
        for j, v in rows:
            if v and None not in v and j != i and len(v) == len(q):
                best.setdefault(j, []).append(sum(a * b for a, b in zip(q, v)))
        want = sorted(((s, j) for j, all_ in best.items() for s in all_), key=lambda x: (-x[0], x[1]))[:7]
        assert [(n, j, s) for n, (s, j) in enumerate(want, 1)] == sorted(got[i])
    assert topk.search(df.limit(0), F.col("vec_id") == 0, 5, "vec_id", "v").count() == 0


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for e in links if e[0] != e[1] for x in e}


def near_texts(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(r.choice(words) for _ in range(30))
    out = []
    while len(out) < n:
        size = r.choice([0, 1, 2, 3, 5, 9, 12, 16, 22, 40, 80, 300])
        base = [r.choice(words) for _ in range(size)]
        for _ in range(r.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, size // 60])):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t).upper() + ("\t\n" + passage if r.random() < 0.3 else ""))
    return [*out, None, "", " \x0b "]


def linked_by_hand(texts, words, num):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= num * (len(a) + len(sets[j]) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("words", "num", "seed"), [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_jaccard_join_loses_no_link(spark, words, num, seed):
    texts = near_texts(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n", "2 as id", "'k' as key")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, jaccard.Rule(words, num)).collect()}
    assert got == linked_by_hand(texts, words, num)


def test_jaccard_join_of_repeated_ids_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df, jaccard.Rule(4, 85)).collect()), key=str) == [(1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert jaccard.join(df.limit(0), jaccard.Rule(4, 85)).count() == 0


@pytest.mark.parametrize("num", [60, 80, 85, 95])
def test_boundaries_and_overlaps(num):
    rule = jaccard.Rule(4, num)
    for a in range(1, 60):
        for b in range(a, 90):
            fits = b <= rule.most(a)
            c = rule.overlap(a, b)
            assert fits == (c <= a) and (not fits or 100 * c >= num * (a + b - c)) and 100 * (c - 1) < num * (a + b - c + 1)
    assert rule.boundary({5: 10, 20: 10}) in range(1, jaccard.SMALL_MOST + 1)


def test_shingles_are_those_of_words():
    r = random.Random(4)
    words = ["a", "Bc", "é", "twelve-bytes", "x" * 16, "y" * 63, "z" * 64, "Q" * 65, "q" * 65, "long" * 90, "\x85", "\xa0"]
    texts = [r.choice(["", " ", "\t"]).join([" \n\x0b".join(r.choice(words) for _ in range(r.randrange(0, 9)))] * r.choice([1, 2])).encode() for _ in range(400)] + [b"", b"  ", b"one", b"one"]
    flat, n = jaccard.Shingler(3).sets(texts)
    end, by_hash = np.cumsum(n), {}
    for t, a, b in zip(texts, end - n, end):
        w = t.lower().split()
        want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
        assert len(want) == b - a and (np.diff(flat[a:b].astype(object)) > 0).all()
        by_hash.setdefault(frozenset(want), set()).add(flat[a:b].tobytes())
    assert all(len(x) == 1 for x in by_hash.values()) and len({x for v in by_hash.values() for x in v}) == len(by_hash)


@pytest.mark.parametrize("blocks", [1 << 20, 400])
def test_jaccard_join_of_long_lists_and_many_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "ENTRIES", blocks)
    r = random.Random(7)
    base, texts = [f"w{i}" for i in range(90)], []
    for _ in range(150):  # copies that differ from each other twice as much as from the first
        t = list(base)
        for _ in range(r.randrange(0, 4)):
            t[r.randrange(len(t))] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(df, jaccard.Rule(4, 85), long=16).collect()}
    assert got == linked_by_hand(texts, 4, 85)


def test_jaccard_join_of_an_id_with_two_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white")
    rows = [(5, a), (5, b), (3, b), (9, a), (2, c), (8, c), (8, ""), (7, None), (7, "solo word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(df, jaccard.Rule(4, 85)).collect()) == [(2, 2, 2), (3, 3, 3), (5, 3, 3), (7, 1, 7), (8, 2, 2), (9, 2, 3)]


def test_jaccard_join_links_sizes_where_the_overlap_rises(spark):
    texts = []
    for i in range(150):  # 25 and 27 shingles, 24 in common: 24 / 28
        shared = [f"s{i}x{j}" for j in range(27)]
        texts += [" ".join([*shared, f"a{i}"]), " ".join([*shared, f"b{i}", f"c{i}", f"d{i}"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, jaccard.Rule(4, 85)).collect()}
    assert got == {i: ((25, i) if i % 2 == 0 else (27, i - 1)) for i in range(300)}


@pytest.mark.parametrize("seed", range(4))
def test_suffix_arrays(seed):
    r = random.Random(seed)
    for _ in range(60):
        s = bytes(r.randrange(97, 97 + r.choice([1, 2, 3, 26])) for _ in range(r.randrange(0, 60))) * r.choice([1, 2, 3])
        t = np.frombuffer(s, dtype=np.uint8)
        order = suffix.suffix_array(t)
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert order.tolist() == want
        if len(s):
            before, shared = suffix.common_prefixes(t, order, 40, r.choice([1, 3, 16]))
            for x, y in zip(want, want[1:]):
                n = next((k for k in range(40) if max(x, y) + k >= len(s) or s[x + k] != s[y + k]), 40)
                assert before[y] == x and shared[y] == n


def repeats_by_hand(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_against_all_windows(spark):
    r = random.Random(9)
    letters = "abcdefgh é"
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [make(n) for n in (60, 99, 100, 101, 260)]
    texts = [make(r.choice([0, 20, 99, 100, 300, 900])) + "".join(r.choice(passages) + make(r.randrange(0, 40)) for _ in range(r.randrange(0, 3))) for _ in range(70)]
    texts += [texts[3], texts[3], "z" * 450, "ab" * 200, make(150) * 3, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as id", "'s' as spans", "2 as uid")
    got = {x.doc_id: (x._n_bytes, x._n_removed, x._n_spans, hashlib.sha256(bytes(x._kept)).hexdigest()) for x in substrings.remove(df, length=100).collect()}
    assert got == dict(enumerate(repeats_by_hand([(t or "").encode() for t in texts], 100)))


def test_repeated_rows_null_ids_and_whole_characters(spark):
    t = "é" * 120
    df = spark.createDataFrame([(1, t), (1, t), (None, "x" + t), (2, "only")], "doc_id long, text string")
    got = substrings.remove(df, length=100, whole_characters=True).collect()
    assert sorted(bytes(x._kept).decode() for x in got) == ["", "", "only", "x"]
    assert substrings.remove(df.limit(0), length=100).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "repeated_passages", "source_weights", "packed_sequences"]
    r = random.Random(12)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("en", "ol", "ir", "ast", "um")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    junk = lambda n: " ".join(r.choice(["BUY!!", "NOW!!", "$$$"]) for _ in range(n))
    passage, rows, labels = prose(60), [], []
    for i in range(160):
        bad = i % 5 == 2
        rows.append((i, junk(150) if bad else prose(150) + (" " + passage if i in (10, 20, 30) else ""), "en", f"s{i % 3}", 0))
        labels.append((i, int(not bad), 0))
    rows += [(900, rows[0][1], "en", "s0", 0), (901, rows[1][1].replace(words[0], words[1], 1), "en", "s1", 0), (902, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {x.doc_id: x for x in docs.collect()}
    good = {i for i in range(160) if i % 5 != 2}
    assert good <= set(seen["quality_classifier"]) and len(set(seen["quality_classifier"]) & set(range(160)) - good) <= 3
    assert {900, 901}.isdisjoint(seen["near_duplicates"]) and good <= set(seen["near_duplicates"])
    for i in (10, 20, 30):
        assert passage not in seen["repeated_passages"][i].text and seen["repeated_passages"][i].n_chars == len(seen["repeated_passages"][i].text)
    assert seen["repeated_passages"][11].text == rows[11][1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_keeps_one_of_repeated_rows_and_null_ids(spark):
    import corpus_pipeline

    r = random.Random(31)
    a, b, c, d = (" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(4))
    near = b.replace(b.split()[0], "other", 1)
    rows = [(1, a), (1, a), (5, b), (2, b), (None, b), (None, near), (None, c), (None, c), (3, d), (4, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.near_duplicates(spark, docs, "")
    want = [(1, a), (2, b), (3, d), (4, ""), (6, None), (None, c)]
    assert sorted(((x.doc_id, x.text) for x in once.collect()), key=repr) == sorted(want, key=repr)
    left = corpus_pipeline.repeated_passages(spark, once, "").collect()
    assert sorted(((x.doc_id, x.text or "") for x in left), key=repr) == sorted(((i, t or "") for i, t in want), key=repr)


def crowded(spark, rows):
    """Documents with columns named as those that operators use themselves."""
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *(f"{k} as `{c}`" for k, c in enumerate(["score", "_t", "_kept", "_n_bytes", "_tokens", "_copies", "_weight", "_row", "row", "id", "uid", "rest", "spans", "component_id", "_copy", "_source", "_key"])))


def test_every_stage_against_a_loop(spark, tmp_path):
    import corpus_pipeline

    from tests.llm.test_text_operators import mix_by_hand

    r = random.Random(77)
    words = [f"w{i}é" for i in range(900)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, rows = prose(50), []
    for i in range(90):
        t = prose(r.choice([3, 30, 90])) + (" " + passage if i % 9 == 0 else "")
        rows.append((i, t, r.choice(["a", "a", "a", "b", None])))
        if i % 10 == 3:
            rows.append((300 + i, t.replace(" ", "  ", 1), "b"))
        if i % 15 == 4:
            rows += [(i, t, "a"), (None, t, "a")]
    rows += [(500, None, "a"), (501, "", None), (501, "", None)]
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = crowded(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    from tessera.llm import quality
    from tessera.llm.queries import QUALITY_THRESHOLD, held_out

    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").where(~held_out()))
    scores = quality.Scorer(model).scores([(t or "").encode() for _, t, _ in rows])
    out = stages["quality_classifier"](spark, docs, str(tmp_path))
    key = lambda x: (x is None, x or 0)
    assert out.columns == docs.columns and sorted((x.doc_id for x in out.collect()), key=key) == sorted((i for (i, *_), p in zip(rows, scores) if p >= QUALITY_THRESHOLD), key=key)

    out = stages["near_duplicates"](spark, docs, "")
    groups = collections.defaultdict(list)
    for at, (_, g) in linked_by_hand([t for _, t, _ in rows], 5, 80).items():
        groups[g].append(rows[at][0])
    assert out.columns == docs.columns and sorted((x.doc_id for x in out.collect()), key=key) == sorted((min(g, key=key) for g in groups.values()), key=key)

    out = stages["repeated_passages"](spark, docs, "")
    data = [(t or "").encode() for _, t, _ in rows]
    seen = collections.Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    want = []
    for (i, *_), t in zip(rows, data):
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left, at = "", 0
        for c in t.decode():
            size = len(c.encode())
            left, at = left + ("" if gone[at : at + size].any() else c), at + size
        want.append((i, left, len(left)))
    assert out.columns == docs.columns and sorted(((x.doc_id, x.text, x.n_chars) for x in out.collect()), key=repr) == sorted(want, key=repr)

    own = [(i, s, len((t or "").encode().split())) for i, t, s in rows if i is not None]
    out = stages["source_weights"](spark, docs.where("doc_id is not null"), "")
    copies = mix_by_hand(own, 0.98, 2.0)
    assert out.columns == docs.columns and collections.Counter(x.doc_id for x in out.collect()) == collections.Counter({i: 0 for i in ()}) + collections.Counter(x for i, _, n in own if n for x in [i] * copies[i])
    packed = stages["packed_sequences"](spark, docs, "").collect()
    assert collections.Counter(x.doc_id for x in packed) == collections.Counter(i for i, *_ in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def broadcast_copies(df):
    """Operators that repeat rows below a broadcast, in the plan before it runs."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda x: re.search("[A-Za-z]", x) and re.search("[A-Za-z]", x).start() > line.index("BroadcastExchange"), lines[i + 1 :])
            found += [x for x in below if "Generate" in x]
    return found


def test_top_k_gathers_no_copies_of_blocks_at_the_driver(spark, monkeypatch):
    """The sides of a search are small by Spark's estimates, as their files are: no plan may broadcast what it repeats of them."""
    monkeypatch.setattr(topk, "CANDIDATES", 32)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(grid, "KEPT", 2000)
    monkeypatch.setattr(grid, "PASSED", 2000)
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (700, 12))
    x[100:300] = x[100]  # equal scores beyond a list
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<long>")
    out = topk.search(df, F.col("vec_id") % 5 == 0, 6, "vec_id", "v")
    assert not broadcast_copies(out)
    scores = x @ x.T
    expected = [(q, k + 1, i, int(scores[q, i])) for q in range(0, 700, 5) for k, i in enumerate(sorted((i for i in range(700) if i != q), key=lambda i: (-scores[q, i], i))[:6])]
    assert sorted(map(tuple, out.collect())) == expected


def test_prefixes_are_compared_only_where_windows_start(monkeypatch):
    """Of a part, only the windows that lie in it can repeat: lengths of other places aren't asked, and those asked are the same."""
    rng, asked = random.Random(8), []
    parts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (20, 5, 26, 20, 19, 0, 31)] * 2
    real = suffix.common_prefixes

    def spied(text, order, most, **more):
        asked.append(more["wanted"])
        (before, all_), (same, got) = real(text, order, most), real(text, order, most, **more)
        assert (before == same).all() and (all_[more["wanted"]] == got[more["wanted"]]).all() and (got <= all_).all()
        return same, got

    monkeypatch.setattr(substrings, "common_prefixes", spied)
    seen = collections.Counter(p[i : i + 20] for p in parts for i in range(len(p) - 19))
    assert [x.tolist() for x in substrings.repeats(parts, 20)] == [[i for i in range(len(p) - 19) if seen[p[i : i + 20]] > 1] for p in parts]
    assert asked[0].sum() == sum(max(0, len(p) - 19) for p in parts)
