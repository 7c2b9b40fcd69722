"""Texts are cut into words once, however often the counts are read; words are found once for their pairs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark import queries as library
from tidemark.operators import labels

TEXTS = [("a", "alpha beta alpha beta gamma"), ("a", "delta"), ("b", None), (None, "alpha beta rho-sigma"), ("c", "x yy the beta"), ("c", ""), ("d", "one-two three_four beta")]


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.executedPlan().toString() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan.toString()


@pytest.mark.parametrize("name", ["tfidf_terms", "source_terms", "source_labels"])
def test_texts_are_cut_once(spark, sf_dir, name):
    plan = final_plan(library.QUERIES[name](spark, sf_dir))
    assert plan.count("regexp_extract_all(") == 1
    assert "ReusedExchange" in plan


def test_words_and_pairs(spark):
    df = spark.createDataFrame(TEXTS, "id string, text string")
    words = df.select("id", labels.label_words(F.col("text"), ("the",)).alias("words"))
    got = {(r.id, r.term): r.tf for r in labels.counted(labels.with_pairs(words)).collect()}
    want = Counter()
    for r in words.collect():
        w = list(r.words)
        for term in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]:
            want[r.id, term] += 1
    assert got == dict(want) and got["a", "alpha beta"] == 2 and ("a", "gamma delta") not in got


def test_groups_without_words_and_null_groups(spark):
    df = spark.createDataFrame(TEXTS, "episode_id string, text string")
    got = {r.episode_id: r.terms for r in labels.group_labels(df, stop=("the",)).collect()}
    assert got[None] == [] and got["b"] == [] and "delta" in got["a"] and set(got) == {"a", "b", "c", "d", None}
    assert got["c"] == []  # its one word is in over 80 % of the groups, the null one counted
    named = labels.group_labels(df.withColumnRenamed("episode_id", "id"), key="id", stop=("the",)).collect()
    assert {r.id: r.terms for r in named} == got and labels.group_labels(df.where("false"), stop=()).collect() == []
