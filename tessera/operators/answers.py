"""What a model says, asked once: answers kept by key, misses asked in batches of like length, failures left to be asked again.

Facts of parent texts (R15) and keywords of queries (R2) rest on it. Answers are a table of segments under one manifest, so those of a batch are kept together or not at all."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import facts, strip
from tessera.operators.inference import batched
from tessera.plans.staging import materialise, picked
from tessera.plans.tables import Segments

Model = Callable[[list[str]], Sequence]


class Answers:
    """Answers at ``root`` (a new place where none is given)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.tables = spark, Segments(spark, root)

    def held(self) -> DataFrame:
        """key and answer of all that is kept."""
        state = self.tables.state()
        if not state.folders("answers"):
            return self.spark.createDataFrame([], "key string, answer string")
        return self.tables.live("answers", state).select("key", "answer")

    def ask(self, asked: DataFrame, key: str, text: str, model: Model, good: Column, budget: int = 1 << 16) -> DataFrame:
        """key, answer, hit and error of each different key: the answer kept, else the model's, which is kept if it is ``good`` (a condition on ``answer``).

        Keys that are null are asked and not kept; so are answers that aren't good."""
        named = asked.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
        first = materialise(named.where("key is not null").groupBy("key").agg(F.min("text").alias("text")), "asked")
        known = materialise(picked(self.held(), first.select("key"), ["key"]), "known")
        misses = first.join(known, "key", "left_anti")
        new = materialise(batched(misses, "text", model, ["key"], budget=budget).select("key", F.col("result").alias("answer"), "error"), "answered")
        kept = new.where(F.col("error").isNull() & F.coalesce(good, F.lit(False)))
        if not kept.isEmpty():
            before = self.tables.state()
            rows = kept.select("key", "answer", F.lit(before.version + 1).alias("segment"))
            self.tables.commit(before, appended={"answers": self.tables.write("answers", rows)} | self.tables.overtaken("answers", kept.select("key"), before))
        return known.select("key", "answer", F.lit(True).alias("hit"), F.lit(None).cast("string").alias("error")).unionByName(new.select("key", "answer", F.lit(False).alias("hit"), "error"))


def facts_of(parents: DataFrame, answers: Answers, model: Model, key: str = "parent_id", text: str = "parent_text") -> DataFrame:
    """Parents with ``facts``, ``hit`` and ``body``: their facts as a list, or the raw text where there are none, so that nothing is lost."""
    got = materialise(answers.ask(parents, key, text, model, F.size(facts(F.col("answer"))) > 0), "facts")
    joined = parents.join(got.select(F.col("key").alias("_key"), facts(F.col("answer")).alias("facts"), "hit"), F.col(key).cast("string") == F.col("_key"), "left").drop("_key")
    listed = F.array_join(F.transform("facts", lambda x: F.concat(F.lit("- "), x)), "\n")
    return joined.withColumns({"facts": F.coalesce("facts", F.array().cast("array<string>")), "hit": F.coalesce("hit", F.lit(False))}).withColumn("body", F.when(F.size("facts") > 0, listed).otherwise(F.col(text)))


def source_header(name: Column, section: Column) -> Column:
    """The line above a parent's facts."""
    return F.concat(F.lit("[Source: "), F.coalesce(F.when(name != "", name), F.lit("document")), F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" | Section: "), section)).otherwise(""), F.lit("]"))


def keywords_of(queries: DataFrame, answers: Answers, model: Model, query: str = "query", short: int = 50) -> DataFrame:
    """Queries with ``low`` and ``high`` keywords, from a model's JSON (low_level_keywords, high_level_keywords), and ``error``.

    A query of under ``short`` characters that has none is its own low keyword; a longer one is refused."""
    parts = {"low": "low_level_keywords", "high": "high_level_keywords"}

    def listed(answer: Column, name: str) -> Column:
        inner = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1)
        got = F.from_json(F.get_json_object(inner, f"$.{name}"), "array<string>")
        return F.filter(F.transform(F.coalesce(got, F.array().cast("array<string>")), strip), lambda x: x != "")

    some = F.size(listed(F.col("answer"), parts["low"])) + F.size(listed(F.col("answer"), parts["high"])) > 0
    got = materialise(answers.ask(queries, query, query, model, some), "keywords")
    rows = queries.join(got.select(F.col("key").alias(query), *(listed(F.col("answer"), v).alias(k) for k, v in parts.items())), query, "left")
    none = F.coalesce(F.size("low") + F.size("high"), F.lit(0)) <= 0
    own = F.when(none & (F.length(query) < short), F.array(query)).otherwise(F.coalesce("low", F.array().cast("array<string>")))
    return rows.withColumn("error", F.when(none & (F.length(query) >= short), "no keywords for a long query")).withColumns({"low": own, "high": F.coalesce("high", F.array().cast("array<string>"))})
