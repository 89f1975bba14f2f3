"""Features of questions and the sources they open, as stated by hand."""

import pytest
from pyspark.sql import functions as F

from memspark.functions import asking as ak

SYN = {"blue": ["azure"]}


def features(spark, text):
    return spark.createDataFrame([(text,)], "q string").select(ak.query_features(F.col("q"), SYN).alias("f")).first().f.asDict()


def test_there_are_27_features_and_empty_questions_have_none(spark):
    for text in (None, "", " \n\t"):
        f = features(spark, text)
        assert len(f) == 27 and f["is_short"] and not any(v for k, v in f.items() if k != "is_short")


def test_features_of_one_question(spark):
    f = features(spark, "  How does Azure differ from \"Red\" in 1999, not 12.05?  ")
    assert (f["length"], f["chars"], f["n_capitalized"]) == (10, 52, 2)
    assert [k for k, v in f.items() if v is True] == ["is_question", "has_question_mark", "is_negated", "has_entity", "has_numbers", "has_date", "has_year", "has_quote"]
    # Eleven words; "in", "12" and "05" are too short to count, "in" alone is a light word.
    assert (f["unique_ratio"], f["stopword_ratio"], f["avg_word_len"]) == (0.727, 0.091, 3.45)


@pytest.mark.parametrize(("text", "sources"), [
    ("list all azure things?", "wiki core graph"),
    ("blue", "rag core"),
    ("why is azure so slow here today", "rag wiki core graph"),
    ("please look once more into main.py and others", "rag wiki core"),
    ("why did it stop working since yesterday", "rag episodic core"),
    ("tell me something about the weather there", "rag wiki episodic core graph"),
    ("x" * 20_000 + " how are you and so on", "rag wiki episodic core graph"),
])
def test_sources_of_questions(spark, text, sources):
    got = spark.createDataFrame([(text,)], "q string").select(ak.gate_sources(ak.query_features(F.col("q"), SYN)).alias("g")).first().g.asDict()
    assert {s for s, on in got.items() if on} == set(sources.split())
