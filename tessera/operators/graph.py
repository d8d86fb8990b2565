"""Operators on an undirected graph of nodes (entity_id, ...) and edges (src, tgt, ...) with src <= tgt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import materialise


def canonical(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")})


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (node, other)."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("tgt").alias("other")), F.struct(F.col("tgt").alias("node"), F.col("src").alias("other")))).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def degrees_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of each named node; 0 for those without edges."""
    return nodes.select("node").distinct().join(degrees(edges), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """Sum of the degrees of an edge's ends."""
    d = degrees(edges)
    return edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("tgt"), F.col("degree").alias("dt")), "tgt").withColumn("edge_degree", F.col("ds") + F.col("dt")).drop("ds", "dt")


def edges_of_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of requested pairs, in the requested orientation."""
    asked = pairs.select("src", "tgt").distinct().withColumns({"_a": F.least("src", "tgt"), "_b": F.greatest("src", "tgt")})
    held = edges.withColumnsRenamed({"src": "_a", "tgt": "_b"})
    return asked.join(held, ["_a", "_b"]).drop("_a", "_b")


def incident(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, other) of each edge at one of the nodes."""
    return both_ways(edges).join(nodes.select("node").distinct(), "node")


def related_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges at the nodes with their edge degree, for ordering by (edge_degree, weight)."""
    wanted = nodes.select("node").distinct()
    at = edges.join(wanted.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(wanted.withColumnRenamed("node", "tgt"), "tgt", "left_semi")).distinct()
    d = degrees(edges)
    return at.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("tgt"), F.col("degree").alias("dt")), "tgt").withColumn("edge_degree", F.col("ds") + F.col("dt")).drop("ds", "dt")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the named nodes and what hangs on them."""
    g = gone.select("node").distinct()
    return nodes.join(g, nodes["entity_id"] == g["node"], "left_anti"), edges.join(g.withColumnRenamed("node", "src"), "src", "left_anti").join(g.withColumnRenamed("node", "tgt"), "tgt", "left_anti")


def popular(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def label_score(label: Column, query: str, anywhere: bool = False) -> Column:
    """1000 for the label itself, 500 for a beginning, else 100 less its length with 50 for a word's beginning; null if it doesn't hold the query.

    ``anywhere``: as the relational back end scores; the 50 go to any label that holds the query behind its first character, whatever else it scores."""
    low, q = F.lower(label), query.lower()
    word = F.when(F.substring(low, 2, 1 << 30).contains(q) if anywhere else low.contains(f" {q}") | low.contains(f"_{q}"), 50).otherwise(0)
    first = F.when(low == q, 1000).when(low.startswith(q), 500)
    if anywhere:
        return F.when(low.contains(q), F.coalesce(first, F.lit(100) - F.length(label)) + word)
    return F.coalesce(first, F.when(low.contains(q), F.lit(100) - F.length(label) + word))


def search_labels(nodes: DataFrame, query: str, k: int, label: str = "entity_id", anywhere: bool = False) -> DataFrame:
    scored = nodes.select(F.col(label).alias("label"), label_score(F.col(label), query, anywhere).alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), "label").limit(k)


def endpoints(edges: DataFrame, position: str) -> DataFrame:
    """End nodes of an ordered edge list in order of first appearance, source before target."""
    each = edges.select(F.posexplode(F.array("src", "tgt")).alias("side", "node"), F.col(position).alias("at"))
    return each.groupBy("node").agg(F.min(F.col("at") * 2 + F.col("side")).alias("first")).orderBy("first")


def subgraph(edges: DataFrame, start: str, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Breadth-first from a node: (node, level) of at most ``most`` nodes, by level, degree and name, and the edges among them.

    Edges and degrees are written once. A level is a join of the edges with the frontier, which is broadcast: it has at most ``most`` rows, as of a level that
    is too large only the nodes of highest degree are kept, and none is searched beyond it."""
    held = materialise(edges, "edges")
    arcs, degree = both_ways(held), materialise(degrees(held), "degrees")
    reached = materialise(arcs.where(F.col("node") == start).select("node").limit(1).select("node", F.lit(0).alias("level")), "level")
    frontier, found = reached, reached.count()
    for level in range(1, depth + 1):
        if not found or found >= most:
            break
        step = arcs.join(F.broadcast(frontier.select("node")), "node", "left_semi").select(F.col("other").alias("node")).distinct().join(F.broadcast(reached.select("node")), "node", "left_anti")
        frontier = materialise(step.join(degree, "node").orderBy(F.desc("degree"), "node").limit(most - found).select("node", F.lit(level).alias("level")), "level")
        reached, n = reached.unionByName(frontier), frontier.count()
        found += n
        if not n:
            break
    kept = materialise(reached, "nodes")
    return kept, induced(held, kept.select("node"), small=True)


def whole_graph(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes of highest degree and the edges among them."""
    held = materialise(edges, "edges")
    kept = materialise(popular(held, most), "popular")
    return kept, induced(held, kept.select("node"), small=True)


def everything(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes and all edges, once each."""
    return nodes.dropDuplicates(["entity_id"]), edges.dropDuplicates(["src", "tgt"])


def induced(edges: DataFrame, nodes: DataFrame, small: bool = False) -> DataFrame:
    """Edges between some nodes; ``small``: these are a list whose length is bounded, and are broadcast."""
    few = F.broadcast(nodes) if small else nodes
    return edges.join(few.withColumnRenamed("node", "src"), "src", "left_semi").join(few.withColumnRenamed("node", "tgt"), "tgt", "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Property merge by key: a new value wins where there is one."""
    rest = [c for c in old.columns if c not in keys]
    both = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in rest)).join(new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in rest)), keys, "full")
    return both.select(*keys, *(F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in rest))
