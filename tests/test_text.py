import pytest
from pyspark.sql import functions as F
from tesserine.functions import text as t

CASES = [
    (t.to_ascii, "Café", "Cafe"),
    (t.to_ascii, "Naïve résumé", "Naive resume"),
    (t.to_ascii, "日本語", ""),
    (t.key_part, "Action Movie!", "action_movie"),
    (t.key_part, "Sci-Fi & Fantasy", "sci_fi_fantasy"),
    (t.key_part, "release_date", "release_date"),
    (t.key_part, "recent:movie", "recentmovie"),
    (t.analysis_text, "A naïve  approach\tto AI.", "A naive approach to AI."),
    (t.key_concepts, "The Robot, the robot and a 1984 dystopia-film", ["robot", "dystopia", "film"]),
    (t.listed_concepts, 'Keywords: 1. "Space", - war, x', ["space", "war"]),
    (t.uri_term, "/c/en/time_travel/n", "time travel"),
    (t.uri_term, "/c/de/zeit", None),
    (t.preview, "x" * 201, "x" * 200 + "..."),
]


@pytest.mark.parametrize("rule,given,want", CASES)
def test_rules(spark, rule, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(rule(F.col("t"))).first()[0] == want


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    for rule in (t.to_ascii, t.key_part, t.analysis_text, t.key_concepts):
        assert df.select(rule(F.col("t"))).first()[0] is None


def test_folding_stays_in_the_jvm(spark):
    given = ["\u00bd\u2122\u2026\ufb01 caf\u00e9 \u65e5", "\u2026" * 3 + "\u01c4", "e\u0301\u0323", "\U0001d400\U0001f100", "plain", ""]
    df = spark.createDataFrame([(g,) for g in given], "t string").select("t", t.to_ascii(F.col("t")).alias("a"), t.key_words(F.col("t")))
    assert {r.t: r.a for r in df.collect()} == {g: t.decomposed(g) for g in given}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
