"""Exports read back give the graph; failed ones leave nothing."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources import exports


def graph(spark):
    nodes = [(f"n{i}", "person" if i % 2 else None, f"says <{i}> & \"more\" | pipe\nline é", [f"c{i}", "c"]) for i in range(40)]
    edges = [(f"n{i}", f"n{i + 1}", i / 3, None if i % 4 else "k,l") for i in range(39)] + [("n5", "n5", 1.0, "loop")]
    return spark.createDataFrame(nodes, "entity_id string, entity_type string, description string, source_ids array<string>").repartition(3), spark.createDataFrame(edges, "src string, tgt string, weight double, keywords string").repartition(2)


def test_graphml_reads_back(spark, tmp_path):
    nodes, edges = graph(spark)
    path = f"file://{tmp_path}/g"
    exports.export(nodes, edges, path, "graphml")
    exports.export(nodes, edges, path, "graphml")  # again: takes the place of the first
    n, e = exports.read_graphml(spark, path)
    want = {r.entity_id: {k: v for k, v in (("entity_type", r.entity_type), ("description", r.description), ("source_ids", json.dumps(r.source_ids, separators=(",", ":")))) if v is not None} for r in nodes.collect()}
    got = n.collect()
    assert len(got) == 40 and {r.entity_id: r.data for r in got} == want
    assert sorted((r.src, r.tgt, float(r.data["weight"]), r.data.get("keywords")) for r in e.collect()) == sorted(map(tuple, edges.collect()))
    files = sorted(p.name for p in Path(tmp_path, "g").iterdir())
    assert "_SUCCESS" in files and not any(f.startswith("_aside") for f in files) and len(files) == 6  # a part a task
    one = next(p for p in Path(tmp_path, "g").iterdir() if p.suffix == ".graphml")
    assert 'attr.name="weight" attr.type="double"' in one.read_text() and exports.read_graphml(spark, str(one))[0].count() + exports.read_graphml(spark, str(one))[1].count() > 0


def test_failed_exports_leave_nothing(spark, tmp_path):
    nodes, edges = graph(spark)
    path = f"{tmp_path}/g"
    exports.export(nodes, edges, path, "graphml")
    seen = lambda: sorted(p.name for p in Path(path).iterdir() if not p.name.startswith("_aside"))  # noqa: E731 (a task that is still ending may write aside)
    before = seen()
    broken = nodes.withColumn("entity_type", F.when(F.col("entity_id") == "n7", F.raise_error(F.lit("lost"))).otherwise("t"))
    with pytest.raises(Exception, match="lost"):
        exports.export(broken, edges, path, "graphml")
    assert seen() == before and exports.read_graphml(spark, path)[0].count() == 40
    with pytest.raises(ValueError):
        exports.export(nodes, edges, path, "docx")


def test_tables_of_a_graph(spark, tmp_path):
    nodes, edges = graph(spark)
    vectors = nodes.select("entity_id", F.lit("[1]").alias("vector_data"))
    exports.export(nodes, edges, f"{tmp_path}/c", "csv", vectors)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/c/entities").collect()
    assert len(back) == 40 and all(json.loads(r.graph_data)["entity_id"] == r.entity_name and r.vector_data == "[1]" for r in back)
    both = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c/relations")
    assert both.count() == 78 and both.where("src_entity = 'n3' and tgt_entity = 'n2'").count() == 1  # from either end, without loops
    exports.export(nodes, edges, f"{tmp_path}/m", "md")
    parts = [p.read_text().splitlines() for p in Path(tmp_path, "m", "entities").glob("*.md")]
    assert sum(len(p) - 4 for p in parts) == 40 and all(p[0] == "## Entities" and p[2] == "| entity_name | source_id | graph_data |" for p in parts)
    exports.export(nodes, edges, f"{tmp_path}/t", "txt")
    assert sum(p.read_text().count("entity_name: ") for p in Path(tmp_path, "t", "entities").glob("*.txt")) == 40
