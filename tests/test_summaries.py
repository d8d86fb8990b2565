"""Summaries by map and reduce against a fold, and what the trigger says."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.hooks import extractive_summary
from tessera.functions.text import SEP
from tessera.operators import summaries


def said(groups):
    """Depends on order and grouping, and is shorter than what it stands for."""
    return [f"{g[0].split()[0]} {len(g)} {g[-1].split()[-1]}" for g in groups]


def by_hand(texts, most, fragments, longest, stretch):
    made = False
    while True:
        sizes = [max(1, len(t.split())) for t in texts]
        if sum(sizes) <= most or len(texts) <= 2:
            if len(texts) < fragments and sum(sizes) < longest:
                return SEP.join(texts), made
            return said([texts])[0], True
        parts = [texts[i : i + stretch] for i in range(0, len(texts), stretch)] if len(texts) > stretch else [texts]
        texts, made = [], True
        for part in parts:
            group, held, groups = [], 0, []
            for t in part:
                n = max(1, len(t.split()))
                if held + n > most and group:
                    if len(group) == 1:
                        groups.append([*group, t])
                        group, held = [], 0
                    else:
                        groups.append(group)
                        group, held = [t], n
                else:
                    group.append(t)
                    held += n
            groups += [group] if group else []
            texts += [g[0] if len(g) == 1 else said([g])[0] for g in groups]


@pytest.mark.parametrize("most,stretch", [(30, 8192), (12, 20), (5, 7)])
def test_summaries_are_those_of_a_fold(spark, monkeypatch, most, stretch):
    monkeypatch.setattr(summaries, "STRETCH", stretch)
    r = random.Random(most)
    held = {f"k{i}": [" ".join(r.choice("abcdefgh") for _ in range(r.choice((1, 2, 3, 9, 40)))) for _ in range(n)] for i, n in enumerate((1, 2, 3, 7, 8, 30, 200, 400))}
    rows = [(k, i, t) for k, texts in held.items() for i, t in enumerate(texts)]
    r.shuffle(rows)
    odd = [(None, 1, "x"), ("none", 1, None), ("none", 2, "")]
    df = spark.createDataFrame(rows + odd, "name string, pos long, description string").withColumn("size", F.lit("clash"))
    got = {x.name: (x.description, x.summarised) for x in summaries.summarise(df, "name", "description", "pos", most=most, fragments=5, longest=25, summary=said).collect()}
    assert got == {k: by_hand(texts, most, 5, 25, stretch) for k, texts in held.items()}


def test_groups_hold_two_fragments_at_least():
    assert summaries.grouped([], 5) == []
    assert summaries.grouped([9, 9, 9], 5) == [[0, 1], [2]]
    assert summaries.grouped([2, 2, 2, 9, 1], 5) == [[0, 1], [2, 3], [4]]
    assert summaries.grouped([1, 1, 1], 5) == [[0, 1, 2]]


def test_default_summary(spark):
    assert extractive_summary([["One thing. Two.", "One thing. Three", "Other! x"], []]) == ["One thing. Other!", ""]
    assert extractive_summary([["a b c d", "e f"]], most=5) == ["a b c d e"]
    df = spark.createDataFrame([("k", i, f"Fact {i}. More of it.") for i in range(9)], "name string, pos long, d string")
    assert [tuple(x) for x in summaries.summarise(df, "name", "d", "pos").collect()] == [("k", " ".join(f"Fact {i}." for i in range(9)), True)]
    assert summaries.summarise(df.limit(0), "name", "d", "pos").count() == 0
