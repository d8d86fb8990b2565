"""Cutting lineage through written tables in the cluster's shared folder.

A stage that is read more than once is written as Parquet under the folder named by
``spark.checkpoint.dir``. Every executor can read it again, so a lost executor costs a
re-read and never a recomputation of what came before.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, on a local master only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage there."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    for paths in getattr(_open, "paths", []):
        paths.append(path)
    return back


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each action go when it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """``cleared``, and at the end what was materialised goes: nothing that is read later may hang on it."""
    made, outer = [], getattr(_open, "paths", [])
    _open.paths = [*outer, made]
    try:
        with cleared(spark):
            yield
    finally:
        _open.paths = outer
        for path in made:
            delete(spark, path)


def bound_batches(spark: SparkSession, most: int = 2000, size: int = 4 << 20) -> None:
    """At most ``most`` rows and about ``size`` bytes in an Arrow batch: whole texts can be long, and a batch stands in memory on both sides, some copies of it in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).removesuffix("b") != str(size):
        spark.conf.set(name, str(size))


def release(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of ids (a few dozen bytes each) up to which a side is broadcast.
BROADCAST_ROWS = 2_000_000


def picked(rows: DataFrame, ids: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """``rows`` joined with the narrow rows ``ids`` (materialised): by a broadcast while these are few, else by a shuffle."""
    few = ids.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, on, how)


#: Rows of a list that one task may order.
LIST_ROWS = 50_000


def numbered(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``rows``, materialised, with their place from 0 in the order: places within ordered parts plus the rows of the parts before; a short list is ordered in one task."""
    rows = rows if getattr(rows, "_tessera_path", None) else materialise(rows, "unordered")
    if rows.count() <= LIST_ROWS:
        return rows.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long") - 1)
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())  # part << 33 | place
    own = materialise(own.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "ordered")
    before, total = [], 0
    for r in sorted(own.groupBy("_part").count().collect()):  # a row a part
        before.append((r._part, total))
        total += r["count"]
    offsets = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    return own.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores if they come from fewer splits of files than there are cores, as those of a small source do; for work that costs much a row."""
    cores, plan = rows.sparkSession.sparkContext.defaultParallelism, rows._jdf.queryExecution().executedPlan().toString()
    return rows.repartition(cores) if "Exchange" not in plan and rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
