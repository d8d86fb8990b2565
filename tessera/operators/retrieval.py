"""Composition of retrieval results: merging lanes, picking chunks, budgets, references, contexts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import edit, graph, search
from tessera.plans.staging import materialise, numbered

@dataclass(frozen=True)
class Query:
    """Parameters of a retrieval (defaults are fixed values)."""

    mode: str = "mix"
    top_k: int = 40
    chunk_top_k: int = 20
    max_entity_tokens: int = 6000
    max_relation_tokens: int = 8000
    max_total_tokens: int = 30000
    system_tokens: int = 0
    query_tokens: int = 0
    threshold: float = 0.2
    related_chunks: int = 5
    pick: str = "weight"  # chunks of entities and relations: by falling quotas, or "vector" by similarity to the query
    rerank: Callable[[Column], Column] | None = field(default=None, compare=False)  # from contents to scores
    least_score: float = 0.0

    def __post_init__(self):
        if self.mode not in ("local", "global", "hybrid", "mix", "naive", "bypass"):
            raise ValueError(f"no mode {self.mode!r}")
        if self.pick not in ("weight", "vector"):
            raise ValueError(f"no way {self.pick!r} to pick chunks")


def round_robin(lanes: Sequence[DataFrame], keys: list[str], rank: str = "rank") -> DataFrame:
    """Lanes merged in turns (first of each, second of each ...), each key at its first place; ``position`` from 1."""
    every = None
    for i, lane in enumerate(lanes):
        part = lane.select(*keys, F.col(rank).alias("_r"), F.lit(i).alias("_l"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(*keys).agg(F.min(F.struct("_r", "_l")).alias("_p"))
    placed = numbered(first.select(*keys, "_p._r", "_p._l"), "_r", "_l", name="position")
    return placed.select(*keys, (F.col("position") + 1).cast("int").alias("position"))


def within_budget(rows: DataFrame, order: list[str | Column], tokens: str, most: int, group: Sequence[str] = ()) -> DataFrame:
    """The longest beginning of an ordered list whose tokens sum to ``most``; nothing from the first row over it on."""
    if most <= 0:
        return rows.limit(0)
    run = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(tokens).over(run)).where(F.col("_sum") <= most).drop("_sum")


def chunks_of(items: DataFrame, item: str, rank: str, sources: str) -> DataFrame:
    """(item, chunk, place in the item) of a ranked list: a chunk belongs to the first item that names it; how many items name it is its count, and items list their chunks by count."""
    each = items.select(F.col(item).alias("item"), F.col(rank).alias("rank"), F.posexplode(sources).alias("pos", "chunk"))
    owned = each.groupBy("chunk").agg(F.min(F.struct("rank", "pos", "item")).alias("f"), F.countDistinct("item").alias("occurrences"))
    order = W.partitionBy("item").orderBy(F.desc("occurrences"), "pos")
    return owned.select("f.item", "f.rank", "f.pos", "chunk", "occurrences").withColumn("place", F.row_number().over(order)).select("item", "rank", "chunk", "occurrences", "place")


def relation_chunks(relations: DataFrame, entity_chunks: DataFrame) -> DataFrame:
    """Chunks of a ranked relation list that no entity brought already."""
    return chunks_of(relations, "item", "rank", "sources").join(entity_chunks.select("chunk"), "chunk", "left_anti")


def weighted_polling(items: DataFrame, most: int, least: int) -> DataFrame:
    """Chunks of ranked items by linearly falling quotas, from ``most`` for the first to ``least`` for the last; what quotas leave unused is filled item by item.

    items: (item, rank from 0, chunk, place from 1 in the item)."""
    sizes = items.groupBy("item", "rank").agg(F.count("*").alias("n"))
    count = sizes.count()
    if not count:
        return items.select("item", "rank", "chunk", "place").limit(0)
    quota = F.lit(most) if count == 1 else F.bround(F.lit(float(most)) - F.col("rank") * (float(most - least) / (count - 1)))
    planned = sizes.withColumn("quota", quota.cast("int"))
    spare = planned.agg(F.sum(F.greatest(F.col("quota") - F.col("n"), F.lit(0)))).first()[0]
    marked = items.join(planned.select("item", "quota"), "item")
    base = marked.where("place <= quota").select("item", "rank", "chunk", "place")
    extra = marked.where("place > quota").orderBy("rank", "place").limit(int(spare)).select("item", "rank", "chunk", "place")
    return base.unionByName(extra)


def references(chunks: DataFrame, path: str = "file_path", order: str = "position") -> DataFrame:
    """Chunks with the number of their file among the files, by how many chunks these have and then by first place; '' for unknown sources."""
    known = chunks.where(F.col(path).isNotNull() & ~F.col(path).isin("", "unknown_source"))
    counts = known.groupBy(path).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    placed = numbered(counts.select(path, (-F.col("n")).alias("n"), "first"), "n", "first", name="reference_id")
    return chunks.join(placed.select(path, (F.col("reference_id") + 1).cast("string").alias("reference_id")), path, "left").withColumn("reference_id", F.coalesce("reference_id", F.lit("")))


def context(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row with the list as JSON lines."""
    line = F.to_json(F.struct(*columns))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def rerank(rows: DataFrame, score: Column, least: float, k: int, key: str) -> DataFrame:
    """Rows by a reranker's score, those under ``least`` left out."""
    return rows.withColumn("rerank_score", score).where(F.col("rerank_score") >= least).orderBy(F.desc("rerank_score"), key).limit(k)


def keyword_sets(query: str, low: Sequence[str], high: Sequence[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Given keywords, or for a short query without any the query itself."""
    if not low and not high:
        if len(query) >= 50:
            raise ValueError("no keywords for a long query")
        return (query,), ()
    return tuple(low), tuple(high)


def local(nodes: DataFrame, edges: DataFrame, vector: Sequence[float], q: Query) -> tuple[DataFrame, DataFrame]:
    """Entities by similarity, with degree and rank; and the edges at them by degree and weight."""
    hits = search.top_vectors(nodes, vector, q.top_k, "entity_id", "embedding", above=q.threshold)
    ranked = hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc("similarity"), "entity_id")) - 1)
    with_degree = ranked.join(graph.degrees(edges).withColumnRenamed("node", "entity_id"), "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    related = graph.related_edges(hits.select(F.col("entity_id").alias("node")), edges.select("src", "tgt", "weight"))
    return with_degree, numbered(related.withColumns({"_d": -F.col("edge_degree"), "_w": -F.col("weight")}), "_d", "_w", "src", "tgt", name="rank").drop("_d", "_w")


def global_(edges: DataFrame, vector: Sequence[float], q: Query) -> tuple[DataFrame, DataFrame]:
    """Relations by similarity; and their ends in order of first appearance."""
    hits = search.top_vectors(edges.withColumn("_k", F.concat_ws("\t", "src", "tgt")), vector, q.top_k, "_k", "embedding", above=q.threshold)
    ranked = hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc("similarity"), "_k")) - 1).drop("_k")
    ends = graph.endpoints(ranked, "rank").withColumn("rank", F.row_number().over(W.orderBy("first")) - 1)
    return ranked, ends.select(F.col("node").alias("entity_id"), "rank")


def _picked_chunks(lane: DataFrame, chunks: DataFrame, vector: Sequence[float], q: Query) -> DataFrame:
    """The chunks (chunk, rank) that a lane of ranked items brings."""
    items = lane.select("item", F.col("rank"), "chunk", "place")
    if q.pick == "vector":
        few = q.related_chunks * items.select("item").distinct().count() // 2
        near = search.pick_vectors(chunks, items, vector, few, "chunk", "embedding")
        return numbered(near.withColumn("_s", -F.col("similarity")), "_s", "chunk").select("chunk", "rank")
    ranked = numbered(items.groupBy("item").agg(F.min("rank").alias("_r")), "_r", "item", name="_nth").select("item", F.col("_nth").cast("int").alias("rank"))
    got = weighted_polling(items.drop("rank").join(ranked, "item"), q.related_chunks, 1)
    placed = got.select("chunk", *(c for c in got.columns if c in ("rank", "place")))
    return numbered(placed.withColumnRenamed("rank", "_r"), "_r", "place").select("chunk", "rank")


def retrieve(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, vector: Sequence[float], q: Query, low: Sequence[float] | None = None, high: Sequence[float] | None = None) -> dict[str, DataFrame]:
    """Entities, relations and chunks of a query in its mode; each with ``position``. A bypassed query has none.

    ``low`` and ``high`` are the vectors of its keywords for entities and for relations (the query's own where there are none).
    nodes: entity_id, embedding, sources, tokens. edges: src, tgt, weight, embedding, sources, tokens. chunks: chunk, embedding, content, tokens, file_path."""
    entity_lanes, relation_lanes, chunk_lanes = [], [], []
    if q.mode in ("local", "hybrid", "mix"):
        found, related = local(nodes, edges, low or vector, q)
        entity_lanes.append(found.select("entity_id", "rank")), relation_lanes.append(related.select("src", "tgt", "rank"))
    if q.mode in ("global", "hybrid", "mix"):
        found, ends = global_(edges, high or vector, q)
        relation_lanes.append(found.select("src", "tgt", "rank")), entity_lanes.append(ends)
    if q.mode in ("mix", "naive"):
        near = search.top_vectors(chunks.select("chunk", "embedding"), vector, q.chunk_top_k, "chunk", "embedding", above=q.threshold)
        chunk_lanes.append(near.select("chunk", (F.row_number().over(W.orderBy(F.desc("similarity"), "chunk")) - 1).alias("rank")))
    out: dict[str, DataFrame] = {}
    if entity_lanes:
        named = round_robin(entity_lanes, ["entity_id"]).join(nodes, "entity_id")
        # both lists feed two more lanes each: written once instead of planned and searched again
        out["entities"] = materialise(within_budget(named, ["position"], "tokens", q.max_entity_tokens).drop("embedding"), "entities")
        joined = round_robin(relation_lanes, ["src", "tgt"]).join(edges, ["src", "tgt"])
        out["relations"] = materialise(within_budget(joined, ["position"], "tokens", q.max_relation_tokens).drop("embedding"), "relations")
        by_entity = materialise(chunks_of(out["entities"], "entity_id", "position", "sources"), "owned")
        as_items = out["relations"].select(F.concat_ws("\t", "src", "tgt").alias("item"), F.col("position").alias("rank"), "sources")
        by_relation = materialise(relation_chunks(as_items, by_entity), "owned")
        chunk_lanes += [_picked_chunks(lane, chunks, vector, q) for lane in (by_entity, by_relation)]
    if chunk_lanes:
        merged = round_robin(chunk_lanes, ["chunk"]).join(chunks.drop("embedding"), "chunk")
        if q.rerank:
            scored = rerank(merged.withColumnRenamed("position", "_found"), q.rerank(F.col("content")), q.least_score, q.chunk_top_k, "_found")
            merged = scored.withColumn("position", F.row_number().over(W.orderBy(F.desc("rerank_score"), "_found"))).drop("_found")  # chunk_top_k rows
        merged = merged.where(F.col("position") <= q.chunk_top_k)
        used = sum(out[x].agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] for x in ("entities", "relations") if x in out)
        left = edit.chunk_budget(q.max_total_tokens, q.system_tokens, used, q.query_tokens)
        out["chunks"] = references(materialise(within_budget(merged, ["position"], "tokens", left), "chunks"))
    return out


#: What an answer shows of each kind, and what stands for what is missing (fixed values).
SHOWN = {
    "entities": {"entity_name": "", "entity_type": "UNKNOWN", "description": "", "source_id": "", "file_path": "unknown_source", "created_at": ""},
    "relationships": {"src_id": "", "tgt_id": "", "description": "", "keywords": "", "weight": 1.0, "source_id": "", "file_path": "unknown_source", "created_at": ""},
    "chunks": {"reference_id": "", "content": "", "file_path": "unknown_source", "chunk_id": ""},
}


def envelope(kind: str, rows: DataFrame, order: str = "position") -> DataFrame:
    """Rows of an answer (kind, position, value: JSON) with the fields that are shown of their kind and defaults for what they lack."""
    fields = [F.coalesce(F.col(c).cast("double" if isinstance(v, float) else "string"), F.lit(v)).alias(c) if c in rows.columns else F.lit(v).alias(c) for c, v in SHOWN[kind].items()]
    return rows.select(F.lit(kind).alias("kind"), F.col(order).cast("int").alias("position"), F.to_json(F.struct(*fields)).alias("value"))


def survivors(originals: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Original rows of what a budget has left."""
    return originals.join(kept.select(*keys).distinct(), keys, "left_semi")


def provenance(lanes: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Chunks (chunk, tags): by which lanes (C: vectors, E: entities, R: relations) each came, with its place there; and how many of each are counted by ``processed``."""
    every = None
    for tag, lane in lanes:
        part = lane.select("chunk", F.concat(F.lit(tag), (F.col("rank") + 1).cast("string")).alias("t"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("chunk").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tags"))


def processed(found: dict[str, DataFrame], kept: dict[str, DataFrame]) -> DataFrame:
    """Rows (kind, found, kept): how many of each kind a search found and a budget left."""
    parts = [found[k].agg(F.lit(k).alias("kind"), F.count("*").alias("found")).crossJoin(kept[k].agg(F.count("*").alias("kept"))) for k in sorted(found)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
