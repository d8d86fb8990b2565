"""A graph that follows its documents: after any coming and going it is that of the documents that are left."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import edit, lifecycle, merge, search
from tessera.plans import staging, tables

M = "name string, type string, description string, source_id string, at timestamp, pos long"
C = "src string, tgt string, keywords string, description string, weight double, source_id string, at timestamp, pos long"
T = datetime.datetime(2024, 1, 1)


def corpus(r, docs):
    chunks, mentions, claims = [], [], []
    for d in docs:
        for k in range(r.randrange(1, 4)):
            chunk = f"{d}-{k}"
            chunks.append((chunk, d, f"text of {chunk}"))
            for j in range(r.randrange(0, 5)):
                pos, at = len(mentions) + len(claims) + 1000 * int(d[1:]), T + datetime.timedelta(hours=r.randrange(9))
                mentions.append((r.choice("ABCDEF"), r.choice(["person", "place"]), r.choice(["tall", "old one", "by the sea", "", f"seen in {d}"]), chunk, at, pos))
                claims.append((r.choice("ABCDEFGH"), r.choice("ABCDEFGH"), r.choice(["kin", "kin,near", "near, far"]), f"claim {r.randrange(4)}", float(r.randrange(1, 5)), chunk, at, pos))
    return chunks, mentions, claims


def frames(spark, rows, docs=None):
    keep = {c[0] for c in rows[0] if docs is None or c[1] in docs}
    return (
        spark.createDataFrame([c for c in rows[0] if c[0] in keep], "chunk string, document string, content string"), spark.createDataFrame([m for m in rows[1] if m[3] in keep], M),
        spark.createDataFrame([c for c in rows[2] if c[5] in keep], C),
    )


def graph(store):
    return {name: sorted(map(repr, store.read(name).collect())) for name in ("chunks", "mentions", "claims", "entities", "relations")}


def test_documents_that_go_leave_nothing_behind(spark, monkeypatch):
    rows = corpus(random.Random(11), [f"d{i}" for i in range(9)])
    gone = lambda *d: spark.createDataFrame([(x,) for x in d], "document string")
    store = lifecycle.GraphStore(spark)
    assert store.delete(gone("d1")).version == 0
    store.insert(*frames(spark, rows, ["d0", "d1", "d2", "d3"]))
    first = graph(store)
    actions = store.actions(gone("d0", "d1", "d2", "d3")).select("action").distinct().collect()
    assert [x.action for x in actions] == ["delete"]
    store.insert(*frames(spark, rows, ["d4", "d5", "d6", "d7", "d8"]))
    assert graph(store) != first
    asked = {(x.kind, x.id): x.action for x in store.actions(gone("d4", "d5", "d6", "d7", "d8")).collect()}
    before = {r.name for r in store.read("entities").collect()}
    real = tables.Tables.write

    def dies(self, name, frame, by=None):
        if name == "relations":
            raise RuntimeError("lost")
        return real(self, name, frame, by)

    whole = graph(store)
    with monkeypatch.context() as m:
        m.setattr(tables.Tables, "write", dies)
        with pytest.raises(RuntimeError):
            store.delete(gone("d4"))
    assert graph(store) == whole  # what died between tables is not seen
    store.delete(gone("d4", "d5", "d6", "d7", "d8", "none"))
    assert graph(store) == first
    left = {r.name for r in store.read("entities").collect()}
    assert all((asked.get(("entity", n)) == "delete") == (n not in left) for n in before)
    store.insert(*frames(spark, rows, ["d2"]))  # again: its chunks are replaced by themselves
    store.compact()
    store.tables.vacuum()
    assert graph(store) == first and graph(lifecycle.GraphStore(spark, store.tables.root)) == first
    store.delete(gone("d0", "d1", "d2", "d3"))
    assert graph(store) == {name: [] for name in first}


def test_rules_of_a_rebuild(spark):
    rows = corpus(random.Random(12), [f"d{i}" for i in range(6)])
    store = lifecycle.GraphStore(spark, after_deletion=(lifecycle.rebuilt_entities, merge.rebuilt_relations))
    store.insert(*frames(spark, rows))
    store.delete(spark.createDataFrame([("d5",)], "document string"))
    _, mentions, claims = frames(spark, rows, [f"d{i}" for i in range(5)])
    touched = {m[0] for m in rows[1] if m[3].startswith("d5")} | {x for c in rows[2] if c[5].startswith("d5") for x in c[:2]}
    want = {r.name: r for r in merge.rebuilt(mentions, claims.where("src <> tgt")).collect() if r.name in touched}
    got = {r.name: r for r in store.read("entities").collect() if r.name in touched}
    assert touched and {n: (r.type, r.description, r.source_ids) for n, r in got.items()} == {n: (r.type, r.description, r.source_ids) for n, r in want.items()}


def test_rebuilt_relations(spark):
    rows = [("b", "a", "y,x", "short", 1.0, "c1", T, 2), ("a", "b", "z", "much longer", 2.0, "c1", T, 3), ("a", "b", "x", "other", 4.0, "c0", T, 1), ("a", "a", "k", "loop", 9.0, "c0", T, 1)]
    got = merge.rebuilt_relations(spark.createDataFrame(rows, C)).collect()
    assert [(r.src, r.tgt, r.weight, r.keywords, r.description, r.source_ids) for r in got] == [("a", "b", 7.0, "x,y,z", "other<SEP>much longer", ["c0", "c1"])]


def test_merged_entities_keep_all_fields(spark):
    edges = [("a", "b", 1.0, "d1", "x,y", "c1", "f1"), ("b", "c", 2.0, "d2", "y, z", "c2<SEP>c1", "f1"), ("a", "c", 5.0, "loop", "k", "c9", "f9"), ("b", "e", 3.0, "alone", "q,  p", "c3", "f3")]
    df = spark.createDataFrame(edges, "src string, tgt string, weight double, description string, keywords string, source_id string, file_path string")
    names = spark.createDataFrame([("a", "M", 0), ("c", "M", 1)], "old string, new string, pos int")
    assert sorted(map(tuple, merge.merge_entities(df, names).collect())) == [("M", "b", 2.0, "d1<SEP>d2", "x,y,z", "c1<SEP>c2", "f1"), ("b", "e", 3.0, "alone", "q,  p", "c3", "f3")]
    nodes = spark.createDataFrame([("c", "t1", "second", "s2"), ("a", "", "first", "s1"), ("M", "t0", "own", None), ("z", "t", "", "s")], "entity_id string, entity_type string, description string, source_id string")
    assert sorted(map(tuple, merge.merge_nodes(nodes, names).collect())) == [("M", "t1", "first<SEP>second<SEP>own", "s1<SEP>s2"), ("z", "t", "", "s")]


def test_edits_of_fields(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, "k"), ("b", "c", 2.0, "l")], "src string, tgt string, weight double, keywords string")
    change = spark.createDataFrame([("b", "a", 9.0, None)], "src string, tgt string, weight double, keywords string")
    assert sorted(map(tuple, edit.edit_relations(edges, change).collect())) == [("a", "b", 9.0, "k"), ("b", "c", 2.0, "l")]
    with pytest.raises(edit.Refused):
        edit.edit_relations(edges, spark.createDataFrame([("x", "a", 9.0)], "src string, tgt string, weight double"))
    nodes = spark.createDataFrame([("a", "t", "d")], "entity_id string, entity_type string, description string")
    assert [tuple(x) for x in edit.edit_entities(nodes, spark.createDataFrame([("a", "new")], "entity_id string, description string")).collect()] == [("a", "t", "new")]
    with pytest.raises(edit.Refused):
        edit.edit_entities(nodes, spark.createDataFrame([("q", "new")], "entity_id string, description string"))


def test_search_over_bases_skips_those_that_fail(spark):
    def base(rows):
        return lambda k: spark.createDataFrame(rows, "id string, parent string, text string, score double").orderBy(F.desc("score")).limit(k)

    def broken(k):
        return spark.read.parquet("/nowhere/at/all")

    skipped: dict[str, str] = {}
    asks = {"one": base([("a", "p1", "x", 0.9), ("b", "p1", "x", 0.8), ("c", None, "same", 0.7)]), "two": broken, "three": base([("d", None, "same", 0.75), ("e", "p2", "y", 0.95), ("f", None, "", 0.99)])}
    got = search.over_bases(asks, 3, "parent", "text", "score", "id", per_base=3, skipped=skipped)
    assert [(r.base, r.id) for r in got.collect()] == [("three", "e"), ("one", "a"), ("three", "d")] and list(skipped) == ["two"]
    with pytest.raises(ValueError):
        search.over_bases({"two": broken}, 3, "parent", "text", "score", "id")


def test_a_graph_counted_in_slices_is_the_same_and_leaves_no_scratch_files(spark, tmp_path, monkeypatch):
    rows, got = corpus(random.Random(5), [f"d{i}" for i in range(4)]), []
    monkeypatch.setattr("tessera.plans.staging.shared_dir", lambda s: f"{tmp_path}")
    monkeypatch.setattr(lifecycle, "SLICES", 2, raising=False)
    for rows_a_slice in (10**6, 5):
        monkeypatch.setattr(lifecycle, "SLICE_ROWS", rows_a_slice, raising=False)
        store = lifecycle.GraphStore(spark)
        store.insert(*frames(spark, rows))
        store.delete(spark.createDataFrame([("d2",)], "document string"))
        assert {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("tessera/*/*")} == {"tables"}
        got.append({name: sorted(map(repr, store.read(name).collect())) for name in ("entities", "relations")})
        for left in tmp_path.glob("tessera/*/gone-*"):
            staging.delete(spark, str(left))
    assert got[0] == got[1]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_rebuild_goes_step_by_step_and_leaves_its_parts_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.plans.staging.shared_dir", lambda s: f"{tmp_path}")
    rows = spark.createDataFrame([("a", "t", "x", "1", T, 1), ("a", "t", "longer", "1", T, 2), ("b", "u", "y", "2", T, 3)], M)
    edges = spark.createDataFrame([("a", "z", "k", "e", 1.0, "2", T, 4)], C)
    got = sorted(tuple(r) for r in merge.rebuilt(rows, edges).select("name", "type", "description", "source_ids").collect())
    assert got == [("a", "t", "longer", ["1"]), ("b", "u", "y", ["2"]), ("z", "UNKNOWN", "e", ["2"])]
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.glob("tessera/*/*")) == ["lone", "part", "part", "part"]
