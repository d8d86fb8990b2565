"""Edits of a stored graph and its side tables: creation with checks, renames, deletions, imports, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import content_id
from tessera.operators import graph, merge

#: Source and file of what is created by hand (fixed value).
MANUAL = "manual_creation"


class Refused(ValueError):
    """An edit that the graph's state doesn't allow."""


def create_entities(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with new ones (entity_id, entity_type, description); refused if one is there already."""
    there = new.join(nodes, "entity_id", "left_semi").limit(1).collect()
    if there:
        raise Refused(f"entity {there[0].entity_id!r} exists")
    return nodes.unionByName(new.select(nodes.columns))


def create_relations(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones (src, tgt, weight or null for 1.0); refused if one is there or an end isn't."""
    asked = graph.canonical(new.withColumn("weight", F.coalesce("weight", F.lit(1.0))))
    there = asked.join(edges, ["src", "tgt"], "left_semi").limit(1).collect()
    if there:
        raise Refused(f"relation {there[0].src!r} - {there[0].tgt!r} exists")
    ends = asked.select(F.explode(F.array("src", "tgt")).alias("entity_id"))
    lost = ends.join(nodes, "entity_id", "left_anti").limit(1).collect()
    if lost:
        raise Refused(f"no entity {lost[0].entity_id!r}")
    return edges.unionByName(asked.select(edges.columns))


def delete_relations(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(graph.canonical(gone).select("src", "tgt").distinct(), ["src", "tgt"], "left_anti")


def rename(nodes: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """An entity under another name, its edges rewired; refused if it isn't there or the name is taken."""
    found = {r.entity_id for r in nodes.where(F.col("entity_id").isin(old, new)).select("entity_id").collect()}
    if old not in found or new in found:
        raise Refused(f"can't rename {old!r} to {new!r}")
    at = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c))
    moved = edges.withColumns({"src": at("src"), "tgt": at("tgt")})
    return nodes.withColumn("entity_id", at("entity_id")), graph.canonical(moved)


def edit_relations(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with new values (src, tgt in either order, some of the other columns) where they aren't null; refused if one isn't there."""
    asked = graph.canonical(changes)
    lost = asked.join(edges, ["src", "tgt"], "left_anti").limit(1).collect()
    if lost:
        raise Refused(f"no relation {lost[0].src!r} - {lost[0].tgt!r}")
    new = [c for c in asked.columns if c not in ("src", "tgt")]
    held = edges.join(asked.select("src", "tgt", *(F.col(c).alias(f"_n_{c}") for c in new)), ["src", "tgt"], "left")
    return held.select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in new else c for c in edges.columns))


def edit_entities(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with new values (entity_id, some of the other columns) where they aren't null; refused if one isn't there."""
    lost = changes.join(nodes, "entity_id", "left_anti").limit(1).collect()
    if lost:
        raise Refused(f"no entity {lost[0].entity_id!r}")
    new = [c for c in changes.columns if c != "entity_id"]
    held = nodes.join(changes.select("entity_id", *(F.col(c).alias(f"_n_{c}") for c in new)), "entity_id", "left")
    return held.select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in new else c for c in nodes.columns))


def entity_row(name: Column, description: Column) -> Column:
    """Id and indexed content of an entity."""
    return F.struct(content_id("ent-", name).alias("id"), F.concat_ws("\n", name, description).alias("content"))


def relation_row(src: Column, tgt: Column, keywords: Column, description: Column) -> Column:
    """Id (of the ends in order) and indexed content of a merged relation."""
    a, b = F.least(src, tgt), F.greatest(src, tgt)
    return F.struct(content_id("rel-", F.concat(a, b)).alias("id"), F.concat_ws("\n", F.concat_ws("\t", keywords, a, b), description).alias("content"))


def import_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with a custom graph put in; ends that nothing stands for become UNKNOWN nodes."""
    every = graph.upsert(nodes, new_nodes, ["entity_id"])
    wired = graph.canonical(new_edges)
    lost = merge.missing_endpoints(every, wired)
    merged = graph.upsert(edges, wired.select(edges.columns), ["src", "tgt"])
    return every.unionByName(lost.select(every.columns)), merged


def keep_listed(mentions: DataFrame, kept: DataFrame, key: str, source: str, most: int) -> DataFrame:
    """Mentions of keys whose capped source list is full only count if their source is on it."""
    listed = kept.select(key, F.col("sources").alias("_s"))
    marked = mentions.join(listed, key, "left")
    return marked.where(F.col("_s").isNull() | (F.size("_s") < most) | F.array_contains("_s", F.col(source))).drop("_s")


def has_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Asked pairs with whether an edge stands between them, in either direction."""
    held = graph.canonical(edges).select(F.col("src").alias("_a"), F.col("tgt").alias("_b"), F.lit(True).alias("_has")).distinct()
    asked = pairs.withColumns({"_a": F.least("src", "tgt"), "_b": F.greatest("src", "tgt")})
    return asked.join(held, ["_a", "_b"], "left").select(*pairs.columns, F.coalesce("_has", F.lit(False)).alias("has"))


def conflicts(rows: DataFrame, uploads: DataFrame, keys: list[str]) -> DataFrame:
    """Uploads whose name (or other keys) is taken."""
    return uploads.join(rows.select(*keys).distinct(), keys, "left_semi")


def reset(rows: DataFrame, where: Column, column: str) -> DataFrame:
    """Rows with a column emptied where a condition holds, as before a document is embedded anew."""
    return rows.withColumn(column, F.when(~F.coalesce(where, F.lit(False)), F.col(column)))


def chunk_budget(total: int, system: int, graph_tokens: int, query: int, reserve: int = 200) -> int:
    """Tokens left for chunks."""
    return max(0, total - (system + graph_tokens + query + reserve))


def replace_document(rows: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """Rows of the documents in ``new`` replaced by theirs."""
    return rows.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new)
