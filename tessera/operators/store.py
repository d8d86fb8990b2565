"""Keyed tables: lookups, upserts, deletes, enqueueing, paging, status roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import content_id, sanitize, summary
from tessera.plans.staging import materialise, picked

STATES = ("pending", "processing", "preprocessed", "processed", "failed")
SORTABLE = ("created_at", "updated_at", "id", "file_path")


def multi_get(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """A row per requested (pos, id), in the order asked; nulls where there is none."""
    return ids.join(rows.withColumnRenamed(key, "id"), "id", "left").orderBy("pos")


def filter_keys(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Requested ids that the table doesn't hold."""
    return ids.select(key).distinct().join(rows.select(key), key, "left_anti")


def metadata_equals(column: str, key: str, value: str) -> Column:
    return F.get_json_object(F.col(column), f"$.{key}") == value


def upsert(old: DataFrame, new: DataFrame, key: str, created: str) -> DataFrame:
    """New rows replace old ones of their key; the time of creation stays."""
    rest = [c for c in old.columns if c not in (key, created)]
    held = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in [*rest, created]), F.lit(True).alias("_old"))
    came = new.select(key, *(F.col(c).alias(f"_n_{c}") for c in [*rest, created]), F.lit(True).alias("_new"))
    both = held.join(came, key, "full")
    return both.select(key, *(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in rest), F.coalesce(f"_o_{created}", f"_n_{created}").alias(created)).select(*old.columns)


def enqueue(docs: DataFrame, existing: DataFrame, order: str, text: str, path: str) -> DataFrame:
    """Documents to be processed: sanitised, the first of equal contents; copies of these or of known documents are failed rows of their own.

    Of copies that share their place in the order, one is the first."""
    # out of a generator, as Spark would put the expression in each place that uses it; and what is decided and shown needs no texts
    clean = docs.select(order, path, F.inline(F.array(F.struct(sanitize(F.col(text)).alias("content"))))).where("content <> ''")
    thin = clean.select(content_id("doc-", F.col("content")).alias("id"), F.col(order), F.col(path), summary(F.col("content")).alias("content_summary"), F.length("content").alias("content_length"))
    thin = materialise(thin.withColumn("_at", F.struct(F.col(order).alias("o"), F.monotonically_increasing_id().alias("row"))), "enqueued")
    first = thin.groupBy("id").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).join(existing.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    odd = materialise(first.where("_n > 1 or _known"), "copied")
    marked = picked(thin, odd, ["id"], "left").withColumn("_dup", F.coalesce(F.col("_known"), F.col("_at") > F.col("_first"), F.lit(False)))
    return marked.select(
        F.when(F.col("_dup"), content_id("dup-", F.concat_ws("-", "id", F.col(order).cast("string")))).otherwise(F.col("id")).alias("id"), F.when(F.col("_dup"), "failed").otherwise("pending").alias("status"),
        "content_summary", "content_length", F.col(path).alias("file_path"), F.col(order).alias("pos"),
    )


def consistent(status: DataFrame, contents: DataFrame) -> DataFrame:
    """Status rows put right: without content they go unless failed; unfinished ones with content are pending again, their error cleared."""
    has = contents.select("id").distinct().withColumn("_has", F.lit(True))
    both = status.join(has, "id", "left").where(F.col("_has").isNotNull() | (F.col("status") == "failed"))
    again = F.col("_has").isNotNull() & F.col("status").isin("processing", "failed")
    return both.select("id", F.when(again, "pending").otherwise(F.col("status")).alias("status"), F.when(~again, F.col("error")).alias("error"))


def page(rows: DataFrame, number: int, size: int, sort: str, key: str, descending: bool = True) -> DataFrame:
    """A page (from 1) of 10 to 200 rows, by a sort column and the key."""
    size, number = min(200, max(10, size)), max(1, number)
    return rows.orderBy(F.desc(sort) if descending else F.asc(sort), key).offset((number - 1) * size).limit(size)


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """Rows by status, and of all."""
    counts = rows.groupBy(status).agg(F.count("*").alias("n"))
    return counts.unionByName(counts.agg(F.lit("all").alias(status), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(status, "n"))


def progress(chunks: DataFrame, doc: str, status: str, done: str = "Succeed", before: DataFrame | None = None) -> DataFrame:
    """Finished chunks, their percentage, and the document's state when all are settled; a percentage of ``before`` (document, progress) is never undercut."""
    sums = chunks.groupBy(doc).agg(F.count("*").alias("total"), F.count_if(F.col(status) == done).alias("succeeded"), F.count_if(F.col(status) == "Failed").alias("failed"))
    final = F.when(F.col("succeeded") == F.col("total"), "Succeed").when(F.col("succeeded") + F.col("failed") == F.col("total"), "Failed").otherwise("Processing")
    got = sums.withColumn("progress", F.expr("succeeded * 100 div total")).withColumn("state", final)
    if before is None:
        return got
    return got.join(before.select(doc, F.col("progress").alias("_old")), doc, "left").withColumn("progress", F.greatest("progress", "_old")).drop("_old")


def counts_with_zero(groups: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    return groups.select(key).distinct().join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def cache_counts(cache: DataFrame) -> DataFrame:
    """Cached answers by mode and type, from ids mode:type:hash."""
    parts = F.split("id", ":")
    return cache.where(F.size(parts) == 3).groupBy(parts[0].alias("mode"), parts[1].alias("type")).agg(F.count("*").alias("n"))


def split_hits(asked: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Requests with the cached value and whether there is one; only the rest needs a model."""
    return asked.join(cache.select(key, value), key, "left").withColumn("hit", F.col(value).isNotNull())


def history(turns: DataFrame, conversation: str, order: str, oldest: int, last: int) -> DataFrame:
    """Of each conversation's first ``oldest`` turns the last ``last``."""
    w = W.partitionBy(conversation).orderBy(order)
    first = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= oldest)
    size = F.count("*").over(W.partitionBy(conversation))
    return first.withColumn("_size", size).where(F.col("_n") > F.col("_size") - last).drop("_n", "_size")


def cascade(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children whose parent is there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def evaluation(scores: DataFrame, column: str, group: str) -> DataFrame:
    """Mean, least and greatest of scores that are numbers, and the share of rows that have one."""
    x = F.when(~F.isnan(column), F.col(column))
    return scores.groupBy(group).agg(F.round(F.avg(x), 6).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.count(x) / F.count("*"), 6).alias("rate"))


def guarded(rows: DataFrame, text: str, blocked: list[str], longest: int = 10_000) -> DataFrame:
    """Rows with why an input is refused: a blocked phrase or its length; null if it isn't."""
    low, reason = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(None).cast("string")
    for phrase in reversed(blocked):
        reason = F.when(low.contains(phrase.lower()), F.lit(f"blocked: {phrase}")).otherwise(reason)
    return rows.withColumn("refused", F.when(F.length(text) > longest, "too long").otherwise(reason))


def exists(rows: DataFrame) -> bool:
    return not rows.isEmpty()


def projected(rows: DataFrame, defaults: dict[str, object], times: Sequence[str] = ()) -> DataFrame:
    """Rows with defaults for what is null and times as seconds of the epoch."""
    shown = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()} | {c: F.unix_timestamp(c) for c in times}
    return rows.select(*(shown[c].alias(c) if c in shown else c for c in rows.columns))


def by_status(rows: DataFrame, states: Sequence[str], status: str = "status") -> DataFrame:
    return rows.where(F.col(status).isin(list(states)))


def by_track(rows: DataFrame, track: str, column: str = "track_id") -> DataFrame:
    return rows.where(F.col(column) == track)


def by_path(rows: DataFrame, path: str, order: Sequence[str], column: str = "file_path") -> DataFrame:
    """The first row of a path; there may be several."""
    return rows.where(F.col(column) == path).orderBy(*order).limit(1)


def children_of(rows: DataFrame, parents: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of some parents, in order of parent, time and id."""
    return rows.join(parents.select(key).distinct(), key, "left_semi").orderBy(key, *order)


def picked_vectors(rows: DataFrame, ids: DataFrame, key: str, column: str) -> DataFrame:
    """Vectors of asked ids; ids that have none are absent."""
    return rows.where(F.col(column).isNotNull()).select(key, column).join(ids.select(key).distinct(), key, "left_semi")


def total_for_paging(rows: DataFrame, size: int) -> DataFrame:
    """How many rows and pages there are."""
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("pages"))


def usage(calls: DataFrame, group: Sequence[str], *tokens: str) -> DataFrame:
    """Calls and sums of token counts."""
    sums = [F.sum(F.coalesce(t, F.lit(0))).alias(t) for t in tokens]
    return calls.groupBy(*group).agg(F.count("*").alias("calls"), *sums, F.sum(sum((F.coalesce(t, F.lit(0)) for t in tokens), F.lit(0))).alias("total_tokens"))


def put_cache(cache: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """The cache with new answers; those that say what is there already, or nothing, change nothing."""
    came = new.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_new"))
    both = cache.select(key, value).join(came, key, "full")
    return both.select(key, F.coalesce("_new", value).alias(value), F.coalesce(~F.col("_new").eqNullSafe(F.col(value)) & F.col("_new").isNotNull(), F.lit(False)).alias("written"))


def clear_cache(cache: DataFrame, modes: Sequence[str], kinds: Sequence[str] = ()) -> DataFrame:
    """What is left of a cache (ids mode:type:hash) without some modes, or without these only of some types."""
    parts = F.split("id", ":")
    gone = (F.size(parts) == 3) & parts[0].isin(list(modes))
    return cache.where(~(gone & parts[1].isin(list(kinds)) if kinds else gone))


def custom_chunks(docs: DataFrame, text: str, chunks: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents given with their chunks, but for known ones; and the chunks by id, in order, blank ones left out and equal ones of a document once."""
    own = docs.withColumn("id", content_id("doc-", sanitize(F.col(text)))).join(known.select("id").distinct(), "id", "left_anti")
    each = own.select(F.col("id").alias("full_doc_id"), F.posexplode(chunks).alias("pos", "raw")).withColumn("content", sanitize(F.col("raw"))).where("content <> ''")
    first = each.groupBy("full_doc_id", "content").agg(F.min("pos").alias("chunk_order_index"))
    return own, first.select(content_id("chunk-", F.col("content")).alias("id"), "full_doc_id", "chunk_order_index", "content")
