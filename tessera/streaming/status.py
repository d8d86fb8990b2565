"""Ingestion as streams: status progress, idempotent work, rejected rows, windows.

Queues with retries become at-least-once streams: work is made idempotent by key, progress only grows, and what can't
be processed goes to a table of rejected rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def progress(chunks: DataFrame, doc: str, status: str, total: str, done: str = "Succeed") -> DataFrame:
    """Share of finished chunks per document, for update mode: counts of finished chunks only grow."""
    return chunks.groupBy(doc).agg(F.count_if(F.col(status) == done).alias("succeeded"), F.max(total).alias("total")).withColumn("progress", F.least(F.lit(100), F.expr("succeeded * 100 div total")))


def once(events: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """Each key once within the watermark, whatever is delivered again."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def last_state(events: DataFrame, key: str, state: str, time: str) -> DataFrame:
    """The latest state of each key."""
    return events.groupBy(key).agg(F.max_by(state, time).alias("state"), F.max(time).alias("at"))


def windowed(events: DataFrame, time: str, delay: str, width: str, slide: str | None, *keys: str) -> DataFrame:
    """Counts by event-time window, late rows beyond the delay left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, delay).groupBy(w, *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def sessions(events: DataFrame, time: str, delay: str, gap: str, key: str) -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", key, "n")


def run(events: DataFrame, reason: Column, work: Callable[[DataFrame, int], None], rejected: str, checkpoint: str) -> StreamingQuery:
    """All that is available, in batches: rows with a reason against them are appended to ``rejected``, the rest goes to ``work``."""

    def batch(df: DataFrame, number: int) -> None:
        marked = df.withColumn("reason", reason)
        marked.where("reason is not null").write.mode("overwrite").parquet(f"{rejected}/batch={number}")  # a repeated batch overwrites itself
        work(marked.where("reason is null").drop("reason"), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
