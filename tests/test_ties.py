"""Rows that names, positions or keys alone don't tell apart, as they come in larger tables."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.operators import merge, search, store, vectors
from tessera.plans import queries_graph, queries_search, registry  # noqa: F401


def test_missing_endpoint_has_the_least_description_though_names_are_prefixes(spark):
    nodes = spark.createDataFrame([("s1",), ("s10",)], "entity_id string")
    edges = spark.createDataFrame([("s1", "x", "s1~x"), ("s10", "x", "s10~x"), ("s1", "y", None), ("s10", "y", "s10~y")], "src string, tgt string, description string")
    got = {(r.entity_id, r.entity_type, r.description) for r in merge.missing_endpoints(nodes, edges).collect()}
    assert got == {("x", "UNKNOWN", "s10~x"), ("y", "UNKNOWN", "s10~y")}


def test_of_copies_with_one_id_a_single_one_is_enqueued(spark):
    docs = spark.createDataFrame([(1, "same", "f"), (1, "same", "f"), (1, "same", "f"), (2, "same", "g"), (3, "new", "h"), (3, "other", "h")], "doc_id int, text string, path string").repartition(4)
    got = sorted((r.pos, r.id[:4], r.status) for r in store.enqueue(docs, spark.createDataFrame([], "id string"), "doc_id", "text", "path").collect())
    assert got == [(1, "doc-", "pending"), (1, "dup-", "failed"), (1, "dup-", "failed"), (2, "dup-", "failed"), (3, "doc-", "pending"), (3, "doc-", "pending")]


def test_cosine_of_a_vector_with_itself_is_one(spark):
    vectors = np.random.default_rng(5).standard_normal((200, 8)).tolist()
    rows = spark.createDataFrame([(v,) for v in [*vectors, [0.0] * 8, [1e-150] * 8]], "v array<double>")
    assert [r.s for r in rows.select(search.cosine(F.col("v"), F.col("v")).alias("s")).collect()][:200] == [1.0] * 200
    assert [r.s for r in rows.select(search.cosine(F.col("v"), F.lit(None).cast("array<double>")).alias("s")).distinct().collect()] == [None]
    tail = [r.s for r in rows.select(search.cosine(F.col("v"), F.col("v")).alias("s")).collect()][200:]
    assert tail[0] is None and abs(tail[1] - 1) < 1e-9


def test_hybrid_and_text_rank_with_repeated_ids_give_what_their_sql_gives(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs = [(i % 40, " ".join(rng.choice(["the", "thing", "was", "x", "y", "z"], 1 + i % 9))) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(30)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("v5_hybrid_weighted", "v6_text_rank"):
        got, want = (sorted(map(tuple, x)) for x in (registry.QUERIES[name](spark, str(tmp_path)).collect(), duck.sql(registry.SQL[name]).fetchall()))
        assert got == want, name


def test_of_lines_at_one_position_the_first_in_the_table_is_kept(spark, tmp_path):
    rows = [(i // 8, i // 24, 1, 0, float(i), "ANR"[i % 3], "F") for i in range(240)]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).withColumn("l_shipdate", F.lit("2000-01-01").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.name: (r.first, r.last) for r in registry.QUERIES["a14_field_merge"](spark, str(tmp_path)).select("name", "first", "last").collect()}
    assert got == {f"p{p}": (f"AF{24 * p}", f"{'ANR'[(24 * p + 16) % 3]}F{24 * p + 16}") for p in range(10)}
    held = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("k", 0, None)], "name string, pos int, v string")
    for given in (held, held.orderBy("v")):
        assert tuple(given.groupBy("name").agg(merge.merge_field("keep_first", "v", "pos").alias("f"), merge.merge_field("keep_last", "v", "pos").alias("l")).first()) == ("k", "a", "b")


def test_batch_search_is_a_scan_in_blocks_and_joins_no_single_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    held = [(i, (rng.standard_normal(8) if i % 3 else np.ones(8)).astype("float32").tolist()) for i in range(300)]
    rows = spark.createDataFrame(held, "vec_id long, embedding array<float>")
    monkeypatch.setattr(vectors, "BLOCK", 40, raising=False)
    index = vectors.VectorIndex(spark, "vec_id", "embedding")
    index.fit(rows, lists=4)
    index.add(rows)
    asked = rows.where("vec_id < 20")
    got = index.search_all(asked, 6, "vec_id", "embedding", probes=4)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    hits = {(r.query_id, r["rank"]): (r.vec_id, r.similarity) for r in got.collect()}
    for q in (0, 7, 13):
        want = [tuple(r) for r in search.top_vectors(rows, held[q][1], 6, "vec_id", "embedding").select("vec_id", "similarity").collect()]
        assert [hits[q, n] for n in range(1, 7)] == want
