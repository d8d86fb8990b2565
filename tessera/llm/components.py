"""Connected components of a link table, by contraction.

Each round, every vertex points to the neighbour (or itself) whose hash is least; links are carried
over to what their ends point to, and those within one vertex vanish. Hash order shrinks paths as
fast as stars. The pointers of all rounds are then followed from the last back to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import materialise


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every end of the links (a, b): component is the smallest id that links reach."""
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest, pointers = materialise(ends, "links"), []
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        least = both.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("to"))
        to = materialise(least.select("id", F.least("m", own)["to"].alias("to")), "pointers")
        pointers.append(to)
        moved = rest.join(to.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        rest = materialise(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if not pointers:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    root = pointers[-1]
    for to in reversed(pointers[:-1]):
        root = to.join(root.select(F.col("id").alias("to"), F.col("to").alias("_further")), "to", "left").select("id", F.coalesce("_further", "to").alias("to"))
    least = root.groupBy("to").agg(F.min("id").alias("component"))
    return root.join(least, "to").select("id", "component")
