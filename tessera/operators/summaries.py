"""Descriptions of a key brought to one text: joined while they are few and short, else summarised by map and reduce.

A round takes each key whose fragments hold more than ``most`` tokens: in their order they are put into groups of at most ``most``
tokens and at least two fragments, each group is replaced by its summary, and what results is looked at again. Keys that fit, or have two
fragments or fewer, leave the rounds: with fewer than ``fragments`` fragments and ``longest`` tokens they are joined, else summarised a last time.

A key of more than ``STRETCH`` fragments is cut into stretches of so many, by exact places in its order, and each stretch is grouped in a task of its own; keys
of fewer are grouped as a fold over all their fragments would. So no task holds more than a stretch, whatever a hub has. Each round at least
nearly halves a key's fragments, and is written before the next.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hooks import extractive_summary
from tessera.functions.text import SEP, tokens
from tessera.operators.merge import needs_summary
from tessera.plans.staging import materialise, numbered, picked

#: Fragments of a key that one task groups.
STRETCH = 8192


def words(text: Column) -> Column:
    """Tokens of a fragment, by the default tokenizer; one at least."""
    return F.greatest(F.lit(1), F.size(tokens(text)))


def grouped(sizes: list[int], most: int) -> list[list[int]]:
    """Places of fragments in groups: a group that would exceed ``most`` tokens ends, if need be after a second fragment."""
    out, now, held = [], [], 0
    for i, n in enumerate(sizes):
        if now and held + n > most:
            if len(now) == 1:
                out.append([*now, i])
                now, held = [], 0
                continue
            out.append(now)
            now, held = [], 0
        now.append(i)
        held += n
    return [*out, now] if now else out


def _round(rows: DataFrame, most: int, summary: Callable[[list[list[str]]], list[str]]) -> DataFrame:
    """key, stretch, pos, text of each group of a stretch's fragments (key, stretch, pos, text, size), in order."""

    def fold(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["pos", "text"], kind="stable")
        text, groups = held["text"].tolist(), grouped(held["size"].tolist(), most)
        many = [g for g in groups if len(g) > 1]
        said = iter(summary([[text[i] for i in g] for g in many]))
        new = [next(said) if len(g) > 1 else text[g[0]] for g in groups]
        return pd.DataFrame({"key": held["key"].iloc[0], "pos": [int(held["stretch"].iloc[0]) * STRETCH + k for k in range(len(groups))], "text": new})

    return rows.groupBy("key", "stretch").applyInPandas(fold, "key string, pos long, text string")


def _stretched(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Rows with their stretch: 0 for keys that have few fragments."""
    hubs = materialise(sums.where(F.col("n") > STRETCH).select("key"), "hubs")
    if hubs.isEmpty():
        return rows.withColumn("stretch", F.lit(0).cast("long"))
    few = picked(rows, hubs, ["key"], "left_anti").withColumn("stretch", F.lit(0).cast("long"))
    placed = materialise(numbered(picked(rows, hubs, ["key"]), "key", "pos", "text"), "placed")
    first = placed.groupBy("key").agg(F.min("rank").alias("_first"))
    return few.unionByName(placed.join(F.broadcast(first), "key").withColumn("stretch", F.floor((F.col("rank") - F.col("_first")) / STRETCH).cast("long")).drop("rank", "_first"))  # a row a hub


def summarise(
    rows: DataFrame, key: str, value: str, order: str, most: int = 12_000, fragments: int = 8, longest: int = 1200, separator: str = SEP,
    count: Callable[[Column], Column] = words, summary: Callable[[list[list[str]]], list[str]] = extractive_summary,
) -> DataFrame:
    """``key`` (as a string), ``value`` and ``summarised``: whether a summary was made. Rows are fragments, ``order`` (whole numbers) their order; equal ones go by text.

    ``count`` gives the tokens of a text, ``summary`` the summaries of lists of texts. Null and empty fragments, and null keys, are left out."""
    at = rows.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("pos"), F.col(value).alias("text"), F.lit(False).alias("made")).where("key is not null and text <> ''")
    done = []
    while True:
        at = materialise(at.withColumn("size", count(F.col("text")).cast("long")), "fragments")
        sums = materialise(at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max("made").alias("made")), "sums")
        open_ = materialise(sums.where((F.col("total") > most) & (F.col("n") > 2)).select("key", "n"), "open")
        if open_.isEmpty():
            done.append(at)
            break
        done.append(picked(at, open_.select("key"), ["key"], "left_anti"))
        again = _stretched(picked(at, open_.select("key"), ["key"]), open_)
        at = _round(again, most, summary).withColumn("made", F.lit(True))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])  # at most ``most`` tokens, or two texts
    held = every.groupBy("key").agg(texts.alias("texts"), F.sum("size").alias("total"), F.max("made").alias("made"))
    last = needs_summary(F.size("texts"), F.col("total"), fragments, longest)

    @F.pandas_udf("string")
    def said(lists: pd.Series) -> pd.Series:
        return pd.Series(summary([list(x) for x in lists]), dtype=object)

    short = held.where(~last).select(F.col("key").alias(key), F.array_join("texts", separator).alias(value), F.col("made").alias("summarised"))
    return short.unionByName(held.where(last).select(F.col("key").alias(key), said("texts").alias(value), F.lit(True).alias("summarised")))
