"""Answers asked once: facts of parents and keywords of queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import answers


def test_facts_are_extracted_once_and_raw_text_stands_in(spark, tmp_path):
    log = str(tmp_path / "asked")

    def model(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if any("fails" in t for t in texts):
            raise ValueError("model down")
        return ["nothing" if "none" in t else "```json\n" + json.dumps({"facts": [f"fact of {t}", "  "]}) + "\n```" for t in texts]

    asked = lambda: sorted(open(log).read().split("\n")[:-1])
    rows = [("p1", "one"), ("p2", "two"), ("p1", "one"), ("p3", "none here"), ("p4", "fails"), (None, "nameless"), ("p5", "")]
    df = spark.createDataFrame(rows, "parent_id string, parent_text string")
    store = answers.Answers(spark)
    got = sorted((r.parent_id or "", r.facts, r.hit, r.body) for r in answers.facts_of(df, store, model).collect())
    assert got == [("", [], False, "nameless"), ("p1", ["fact of one"], False, "- fact of one"), ("p1", ["fact of one"], False, "- fact of one"), ("p2", ["fact of two"], False, "- fact of two"), ("p3", [], False, "none here"), ("p4", [], False, "fails"), ("p5", [], False, "")]
    assert asked().count("one") == 1 or asked().count("one") == 2  # once in its batch, and alone if the batch failed
    before = len(asked())
    again = {r.parent_id: r.hit for r in answers.facts_of(df, answers.Answers(spark, store.tables.root), model).collect()}
    assert again == {"p1": True, "p2": True, "p3": False, "p4": False, None: False, "p5": False}
    assert set(asked()[0:]) and {x for x in asked()} == {"one", "two", "none here", "fails"} and asked().count("one") + asked().count("two") <= before
    assert sorted(r.key for r in store.held().collect()) == ["p1", "p2"]
    head = spark.createDataFrame([("d", "s"), ("", None)], "n string, s string").select(answers.source_header(F.col("n"), F.col("s")).alias("h")).collect()
    assert [r.h for r in head] == ["[Source: d | Section: s]", "[Source: document]"]


def test_keywords_of_queries(spark):
    def model(texts):
        return [json.dumps({"high_level_keywords": ["theme"], "low_level_keywords": [t.split()[0], " "]}) if "known" in t else "sorry" for t in texts]

    long = "x" * 60
    df = spark.createDataFrame([("a known thing",), ("short",), (long,)], "query string")
    got = {r.query: (r.low, r.high, r.error) for r in answers.keywords_of(df, answers.Answers(spark), model).collect()}
    assert got == {"a known thing": (["a"], ["theme"], None), "short": (["short"], [], None), long: ([], [], "no keywords for a long query")}
