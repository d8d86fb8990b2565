"""Edits that the graph's state allows or refuses."""

from __future__ import annotations

import pytest

from tessera.operators import edit


@pytest.fixture(scope="module")
def held(spark):
    return spark.createDataFrame([("a", "t", "d"), ("b", "t", "d")], "entity_id string, entity_type string, description string"), spark.createDataFrame([("a", "b", 2.0)], "src string, tgt string, weight double")


def test_creation(spark, held):
    nodes, edges = held
    assert edit.create_entities(nodes, spark.createDataFrame([("c", "t", "d")], nodes.schema)).count() == 3
    with pytest.raises(edit.Refused, match="exists"):
        edit.create_entities(nodes, nodes.limit(1))
    with pytest.raises(edit.Refused, match="exists"):
        edit.create_relations(nodes, edges, spark.createDataFrame([("b", "a", None)], edges.schema))
    with pytest.raises(edit.Refused, match="no entity"):
        edit.create_relations(nodes, edges.limit(0), spark.createDataFrame([("a", "z", None)], edges.schema))
    assert [r.weight for r in edit.create_relations(nodes, edges.limit(0), spark.createDataFrame([("b", "a", None)], edges.schema)).collect()] == [1.0]


def test_renames(held):
    nodes, edges = held
    assert [tuple(r) for r in edit.rename(nodes, edges, "a", "z")[1].collect()] == [("b", "z", 2.0)]
    for old, new in (("q", "z"), ("a", "b")):
        with pytest.raises(edit.Refused):
            edit.rename(nodes, edges, old, new)


def test_full_source_lists_admit_only_what_they_list(spark):
    mentions = spark.createDataFrame([("k", "1"), ("k", "9"), ("m", "9"), ("o", "9")], "name string, source string")
    kept = spark.createDataFrame([("k", ["1", "2"]), ("m", ["1"])], "name string, sources array<string>")
    got = sorted(map(tuple, edit.keep_listed(mentions, kept, "name", "source", 2).collect()))
    assert got == [("k", "1"), ("m", "9"), ("o", "9")]


def test_budget():
    assert edit.chunk_budget(1000, 100, 200, 50) == 450 and edit.chunk_budget(100, 100, 200, 50) == 0
