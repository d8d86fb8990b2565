"""Indexes over source tables: built when a query first asks, read by all that follow until the source's files change."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

_built: dict[tuple, Any] = {}


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a source's files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def over(spark: SparkSession, path: str | tuple[str, ...], label: str, build: Callable[[], Any]) -> Any:
    """What ``build`` gives for the source at ``path`` (or several) as it is now."""
    paths = (path,) if isinstance(path, str) else path
    place = (spark.sparkContext.applicationId, label, paths)
    now = tuple(fingerprint(spark, p) for p in paths)
    if place not in _built or _built[place][0] != now:
        _built[place] = (now, build())
    return _built[place][1]
