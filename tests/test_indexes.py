"""Tables that change together, the inverted index against BM25 over all texts, the vector index against a scan."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import postings, search, vectors
from tessera.plans import indexes, tables


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def held(store, name):
    return sorted(r.n for r in store.read(name).collect())


def test_tables_change_together_or_not_at_all(spark, monkeypatch):
    store = tables.Tables(spark)
    assert store.state().version == 0 and store.vacuum() == 0
    first = store.replace({"a": numbers(spark, 1), "b": numbers(spark, 1)})
    store.commit(first, appended={"a": store.write("a", numbers(spark, 2))}, notes={"x": 1})
    assert held(store, "a") == [1, 2] and held(store, "b") == [1] and store.state().notes == {"x": 1}
    with pytest.raises(tables.Conflict):
        store.replace({"a": numbers(spark, 9)}, before=first)
    assert held(store, "a") == [1, 2]
    real = tables.Tables.write

    def dies(self, name, frame, by=None):
        if name == "b":
            raise RuntimeError("lost")
        return real(self, name, frame, by)

    with monkeypatch.context() as m:
        m.setattr(tables.Tables, "write", dies)
        with pytest.raises(RuntimeError):
            store.replace({"a": numbers(spark, 7), "b": numbers(spark, 7)})
    assert held(store, "a") == [1, 2] and held(store, "b") == [1]
    store.replace({"a": numbers(spark, 3)})
    assert [r.n for r in store.read("a", store.state(1)).collect()] == [1]
    assert store.vacuum() == 4  # two old folders, that of the refused change and that of the one that died
    assert held(store, "a") == [3] and held(store, "b") == [1]
    with pytest.raises(ValueError):
        store.state(1)
    assert held(tables.Tables(spark, store.root), "a") == [3]


def texts(r, ids):
    words = ["river", "stone", "harbour", "Été", "naïve", "the", "and", "42"]
    return [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 40))), r.choice(words) + " the") for i in ids]


def test_postings_give_what_bm25_over_all_texts_gives(spark):
    r = random.Random(2)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, heading string")
    rows = dict((x[0], x) for x in texts(r, range(60)))
    weights, query = {"text": 1.0, "heading": 2.0}, "the ete harbour absent"
    index = postings.Postings(spark, "doc_id", ["text", "heading"])
    assert index.bm25(query, 5, weights).count() == 0

    def same():
        want = search.bm25(frame(list(rows.values())), query, 20, "doc_id", weights).collect()
        got = index.bm25(query, 20, weights).collect()
        assert [x.doc_id for x in got] == [x.doc_id for x in want] and [x.score for x in got] == pytest.approx([x.score for x in want], abs=1e-12)

    index.add(frame(list(rows.values())))
    same()
    more = dict((x[0], x) for x in texts(r, range(50, 90))) | {95: (95, None, ""), 96: (96, "", None)}  # ten of them again
    rows |= more
    index.add(frame(list(more.values()) + [(None, "the river", "the")]))
    same()
    for i in (3, 55, 70):
        del rows[i]
    index.remove(spark.createDataFrame([(3,), (55,), (70,), (4444,)], "doc_id long"))
    same()
    rows[55] = (55, "the harbour again", "the")
    index.add(frame([rows[55]]))
    same()
    index.compact()
    index.tables.vacuum()
    same()
    plan = index.matching(["harbour"])._jdf.queryExecution().executedPlan().toString()
    wanted = spark.range(1).select(postings.bucket(F.lit("harbour")).alias("b")).first().b
    assert f"= {wanted})" in plan.split("PartitionFilters")[1][:120]
    assert "PushedFilters" in plan and "harbour" in plan.split("PushedFilters")[1][:200]
    assert index.bm25("absent", 5, weights).count() == 0


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((20, 12)) * 3
    return [(i, (middles[i % 20] + rng.standard_normal(12)).tolist(), i % 7) for i in range(n)]


def test_vector_index_finds_neighbours_in_few_lists(spark):
    rows = clustered(1500)
    odd = [(9001, None, 0), (9002, [0.0] * 12, 0), (9003, [float("nan")] * 12, 0), (None, [1.0] * 12, 0), (9004, [1.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label long")
    index = vectors.VectorIndex(spark, "vec_id", "embedding")
    index.fit(df)
    index.add(df)
    state, hits = index.tables.state(), 0
    for q in range(0, 1500, 300):
        want = [r.vec_id for r in search.top_vectors(df.where("vec_id < 9000"), rows[q][1], 10, "vec_id", "embedding").collect()]
        got = index.search(rows[q][1], 10)
        assert set(got.columns) == {"vec_id", "embedding", "label", "similarity"}
        hits += len({r.vec_id for r in got.collect()} & set(want))
        assert [r.vec_id for r in index.search(rows[q][1], 10, probes=1, exact=True).collect()] == want
        far = index.beyond(rows[q][1], state, 0.9)
        assert len(far) < len(state.notes["nearest"]) / 2  # radii rule lists out
    assert hits >= 45
    all_files, read = index.tables.read("rows").inputFiles(), index.in_lists(index.probed(rows[0][1], state), state)
    assert state.notes["probes"] < len(state.notes["nearest"]) / 2 and "list" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    assert len(all_files) >= len(state.notes["nearest"])


def test_vector_index_takes_new_rows_for_old_ones_and_lets_rows_go(spark):
    rows = clustered(300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    index = vectors.VectorIndex(spark, "vec_id", "embedding")
    index.fit(df.limit(0))
    assert index.add(df.limit(0)) and index.search(rows[0][1], 5).count() == 0
    index.fit(df)
    index.add(df)
    new = spark.createDataFrame([(5, rows[100][1], 77), (1000, rows[100][1], 78)], "vec_id long, embedding array<double>, label long")
    index.add(new)
    index.remove(spark.createDataFrame([(100,), (7,)], "vec_id long"))
    now = df.where("vec_id not in (5, 7, 100)").unionByName(new)
    want = [(r.vec_id, r.label) for r in search.top_vectors(now, rows[100][1], 12, "vec_id", "embedding").collect()]
    assert [(r.vec_id, r.label) for r in index.search(rows[100][1], 12, exact=True).collect()] == want and want[0] == (5, 77)
    asked = df.where("vec_id in (20, 40)").select("vec_id", "embedding")
    got = index.search_all(asked, 4, "vec_id", "embedding", probes=1000).collect()
    for q in (20, 40):
        want = [r.vec_id for r in search.top_vectors(now, rows[q][1], 4, "vec_id", "embedding").collect()]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_an_index_is_built_anew_only_when_its_source_changes(spark, tmp_path):
    path, built = str(tmp_path / "t.parquet"), []
    spark.range(3).write.parquet(path)
    make = lambda: built.append(1) or len(built)
    assert [indexes.over(spark, path, "x", make) for _ in range(3)] == [1, 1, 1]
    spark.range(4).write.mode("overwrite").parquet(path)
    assert indexes.over(spark, path, "x", make) == 2 and indexes.over(spark, path, "y", make) == 3


def test_registered_vector_index_against_all_cosines(spark):
    from tessera.plans.queries_search import v4_index_batch

    sf = "/root/testdata/sf0.01"
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(x))
    unit = vectors.unit(np.array([x[i] for i in ids]))
    hits = total = 0
    for r in v4_index_batch(spark, sf).groupBy("query_id").agg(F.collect_set("vec_id").alias("found")).collect():
        near = unit @ vectors.unit(x[r.query_id])
        hits += len(set(ids[np.lexsort((ids, -near))[:5]].tolist()) & set(r.found))
        total += 5
    assert total == 5 * len([i for i in ids if i % 50 == 0]) and hits / total >= 0.9
