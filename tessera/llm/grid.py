"""Every block of rows beside every block of queries, in cells of bounded memory.

Blocks of queries are dealt to the lines of a grid and blocks of rows to its columns. A cell is a task: it keeps the
queries of its line, and the blocks of its column pass by one at a time. So each block of rows is sent once a line and
each block of queries once a column. The two sides are sent as one frame, never joined, so no copies of a side can be
taken for a small table and gathered by the driver, whatever the sizes that Spark estimates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import materialise, numbered, picked

#: Bytes of the vectors of a line of queries, which a cell keeps, and of a column of rows, which pass by.
KEPT, PASSED = 16 << 20, 64 << 20


def _dealt(blocks: DataFrame, n: int) -> DataFrame:
    """``blocks`` with ``_to``, a number from 0 to n - 1 that equally many have."""
    if n == 1:
        return blocks.withColumn("_to", F.lit(0))
    places = materialise(numbered(blocks.select("block"), "block", name="_at"), "block-places")
    return picked(blocks, places, ["block"], "inner").withColumn("_to", (F.col("_at") % n).cast("int")).drop("_at")


def cells(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """cell, query, row (one of the two is null): a partition a cell, its queries first. Both sides: materialised, with columns block and vectors."""
    (n, passed), (m, kept) = (df.agg(F.count("block"), F.coalesce(F.sum(F.length("vectors")), F.lit(0))).first() for df in (rows, queries))
    lines = max(1, min(m, -(-kept // KEPT)))
    columns = max(1, min(n, max(-(-passed // PASSED), -(-4 * rows.sparkSession.sparkContext.defaultParallelism // lines))))

    def side(blocks: DataFrame, own: int, copies: int, cell) -> DataFrame:
        to = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        return _dealt(blocks, own).select(to.alias("_copy"), "_to", F.struct(*blocks.columns).alias("_x")).select(cell.cast("int").alias("cell"), "_x")

    def none(blocks: DataFrame):
        return F.lit(None).cast(blocks.select(F.struct(*blocks.columns).alias("x")).schema["x"].dataType)

    left = side(queries, lines, columns, F.col("_to") * columns + F.col("_copy")).select("cell", F.col("_x").alias("query"), none(rows).alias("row"))
    right = side(rows, columns, lines, F.col("_copy") * columns + F.col("_to")).select("cell", none(queries).alias("query"), F.col("_x").alias("row"))
    return left.unionByName(right).repartitionById(lines * columns, F.col("cell")).sortWithinPartitions("cell", F.col("row").isNotNull())


def scan(rows: DataFrame, queries: DataFrame, find: Callable[[list[dict], Iterator[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``find(queries, rows)`` yields in each cell, both as dicts of their columns."""

    def run(batches):
        met = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()) for batch in batches for i in range(len(batch)))
        for _, cell in groupby(met, itemgetter(0)):
            asked = []
            for _, query, row in cell:
                if row is not None:
                    if asked:
                        yield from find(asked, chain([row], (x for _, _, x in cell)))
                    break
                asked.append(query)

    return cells(rows, queries).mapInArrow(run, schema)
