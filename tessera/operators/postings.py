"""A written inverted index for BM25: postings in buckets of terms, a segment for each batch of documents.

A row of ``postings`` is a term in a field of a document, with how often it stands there and the field's length. Rows lie in
``BUCKETS`` partitions by the term's hash, sorted by term, so a query reads the partitions of its own terms, and of their files
the row groups that may hold them. What scores need beside these, the number of documents and the mean length of each field, is one row of
``statistics``. New documents are a segment more. Documents that come again, or go, are listed in ``gone`` with the number
of the first segment that counts, and their older rows don't; ``compact`` writes all that count into one segment.

A posting list that holds a large share of all documents is split over files, as its bucket is rebalanced when it is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.search import bm25_scores, query_terms
from tessera.plans.staging import materialise
from tessera.plans.tables import Segments, State

BUCKETS = 64


def bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings_of(docs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """field, term, key, tf, len of documents, each field cut once. An empty field has a row without a term, for its length."""
    cut = docs.select(F.col(key).alias("key"), F.inline(F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields))))
    cut = cut.select("key", "field", F.inline(F.array(F.struct(F.coalesce("t", F.array().cast("array<string>")).alias("t")))))
    each = cut.select("key", "field", F.size("t").alias("len"), F.explode_outer("t").alias("term"))
    return each.groupBy("key", "field", "len", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


class Postings:
    """An index at ``root`` (a new one where none is given), over the columns ``fields`` of documents named by ``key``."""

    def __init__(self, spark: SparkSession, key: str, fields: Sequence[str], root: str | None = None):
        self.spark, self.key, self.fields, self.tables = spark, key, list(fields), Segments(spark, root)

    def add(self, docs: DataFrame) -> State:
        """Documents put in; those whose key is there already are replaced. A null key is none; of rows with the same key one must be given."""
        return self._change(docs.where(F.col(self.key).isNotNull()), None)

    def remove(self, keys: DataFrame) -> State:
        """Documents taken out."""
        return self._change(None, keys.select(F.col(self.key).alias("key")).distinct())

    def _segment(self, rows: DataFrame, segment: int) -> dict:
        named = rows.where("term is not null").select("term", "field", "key", "tf", "len", F.lit(segment).alias("segment"), bucket("term").alias("bucket"))
        return self.tables.write("postings", named.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), by=["bucket"])

    def _lengths(self, rows: DataFrame, segment: int) -> dict:
        return self.tables.write("lengths", rows.groupBy("key", "field").agg(F.max("len").alias("len")).withColumn("segment", F.lit(segment)))

    def _change(self, docs: DataFrame | None, keys: DataFrame | None) -> State:
        before, appended = self.tables.state(), {}
        segment = before.version + 1
        if docs is not None:
            rows = materialise(postings_of(docs, self.key, self.fields), "postings")
            appended = {"postings": self._segment(rows, segment), "lengths": self._lengths(rows, segment)}
            keys = rows.select("key").distinct()
        elif not before.tables:
            return before
        appended |= self.tables.overtaken("lengths", keys, before)
        sums = self.tables.live("lengths", State(segment, self.tables.with_more(before, appended))).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total")).collect()  # a row a field
        return self.tables.commit(before, appended=appended, notes={"sums": {r.field: [r.n, r.total or 0] for r in sums}})

    def compact(self) -> State:
        """All segments in one, without rows that don't count."""
        before = self.tables.state()
        segment = before.version + 1
        rows = materialise(self.tables.live("postings", before).select("key", "field", "len", "term", "tf"), "postings")
        lengths = self.tables.write("lengths", self.tables.live("lengths", before).withColumn("segment", F.lit(segment)))
        return self.tables.commit(before, replaced={"postings": self._segment(rows, segment), "lengths": lengths, "gone": self.tables.none_gone()})

    def matching(self, terms: Sequence[str], state: State | None = None) -> DataFrame:
        """Postings of some terms: only their buckets are read."""
        state = state or self.tables.state()
        wanted = self.spark.range(1).select(F.explode(F.array(*(F.lit(t) for t in terms))).alias("t")).select(bucket("t").alias("b")).distinct().collect() if terms else []  # of a query's terms
        rows = self.tables.read("postings", state).where(F.col("bucket").isin([r.b for r in wanted]) & F.col("term").isin(list(terms)))
        return self.tables.live("postings", state, rows)

    def bm25(self, query: str, k: int, weights: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """The k documents of the best BM25 score, as ``search.bm25`` gives them."""
        state = self.tables.state()
        terms = query_terms(self.spark.range(0), query)
        if not state.tables:
            return self.spark.createDataFrame([], f"`{self.key}` long, score double")
        rows = self.matching(terms, state).where(F.col("field").isin(list(weights)))
        df = {(r.field, r.term): r.n for r in rows.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")).collect()}  # of the query's terms
        counts = [F.coalesce(F.max(F.when((F.col("field") == f) & (F.col("term") == t), F.col("tf"))), F.lit(0)).alias(f"tf_{f}_{i}") for f in weights for i, t in enumerate(terms)]
        held = rows.groupBy("key").agg(*counts, *(F.coalesce(F.max(F.when(F.col("field") == f, F.col("len"))), F.lit(0)).alias(f"len_{f}") for f in weights))
        sums = state.notes["sums"]
        n = {f: sums.get(f, [0, 0])[0] for f in weights}
        mean = {f: sums[f][1] / sums[f][0] if sums.get(f, [0])[0] else 0.0 for f in weights}
        best = bm25_scores(weights, terms, max(n.values(), default=0), lambda f, i: df.get((f, terms[i]), 0), mean, k1, b)
        return held.select(F.col("key").alias(self.key), best.alias("score")).where("score > 0").orderBy(F.desc("score"), self.key).limit(k)

    def text_rank(self, query: str, k: int, field: str) -> DataFrame:
        """``search.text_rank`` from the postings: the share of a field's tokens that are words of the query."""
        state, none = self.tables.state(), self.spark.createDataFrame([], f"`{self.key}` long, rank double")
        if not state.tables:
            return none
        rows = self.matching(query_terms(self.spark.range(0), query), state).where(F.col("field") == field)
        shares = rows.groupBy(F.col("key").alias(self.key)).agg((F.sum("tf") / F.max("len")).alias("rank"))
        return shares.orderBy(F.desc("rank"), self.key).limit(k)
