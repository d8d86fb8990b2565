"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept; its result is written as Parquet in the shared folder
and read again, so that a lost executor costs one stage's tasks and no more.

Every stage takes a null text for an empty one, keeps the columns of documents whatever else they are called (each works on
the row as one value, so no name clashes with its own) and gives no rows for an empty table. Texts are read whole; a
task holds a few dozen times its longest text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, quality, substrings
from tessera.llm.queries import QUALITY_THRESHOLD, held_out
from tessera.plans.staging import materialise, picked, release, table

NEAR = jaccard.Rule(words=5, num=80)


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows as one value ``row`` beside the columns that an operator reads."""
    return docs.select(F.struct(*docs.columns).alias("row"), *columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on those labelled outside the held-out fifth, doesn't reject.

    Each row is judged by itself, repeated ones and those without an id too. Empty texts get the share of good labels for a score; without labels nothing goes."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    model = quality.fit(docs.select("doc_id", "text"), labels)
    return quality.score(_whole(docs, "text"), model, keep=("row",)).where(F.col("score") >= QUALITY_THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that shared five-word shingles link (Jaccard 0.8 or more), directly or through others, the one with the smallest id.

    Every row counts by itself: of a repeated row one stays, and rows with a null id take part (they stay only where no
    linked row has an id). Texts without words link with nothing and stay."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = materialise(jaccard.join(docs.select("doc_id", "text"), NEAR).where("component_id <> doc_id").select("doc_id"), "gone")
        return picked(docs, gone, ["doc_id"], "left_anti")
    # written, so that each read gives the same numbers
    rows = materialise(_whole(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = jaccard.join(rows.select("_row", "text"), NEAR, key="_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    kept = materialise(groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first).select("first._row"), "kept")
    return picked(rows, kept, ["_row"]).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes that also stand elsewhere, in the same or another row; whole characters go.

    A row of which nothing is left stays, with an empty text. ``n_chars`` is that of the new text."""
    rest = [c for c in docs.columns if c != "text"]
    left = substrings.remove(docs.select(F.struct(*rest).alias("row"), "doc_id", "text"), length=200, whole_characters=True)
    text = F.decode("_kept", "UTF-8")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: as many words as there are, entropy 0.98 of equal shares, no source over twice.

    Rows without words go. A null source is the source ''."""
    mixed = mixing.mix(_whole(docs, "doc_id", "source", "text"), mixing.words("text"), budget_share=1.0, entropy_share=0.98, repetition=2.0)
    return mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with the sequence of 2048 tokens that holds each; a repeated row is packed as often as it comes."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), size=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_weights", source_weights),
    ("packed_sequences", packed_sequences),
]

#: Scores, shingle links and packing are not expressible in SQL; tests hold every stage against a loop over its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
