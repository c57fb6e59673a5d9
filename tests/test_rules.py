from tesserine.operators.detect import PATTERNS, detect_by_patterns
from tesserine.operators.expand import requests
from tesserine.operators.lexicons import lexicon_tags


def test_all_rules_count(spark):
    patterns = spark.createDataFrame([("movie", f"m{i}x", 1.0) for i in range(1500)] + [("book", "isbn", 2.0)], "media_type string, pattern string, weight double").coalesce(1)
    keys = spark.createDataFrame([(1, "ISBN_13"), (2, "m1499x"), (3, "y")], "rec long, key string")
    assert sorted(map(tuple, detect_by_patterns(keys, patterns).collect())) == [(1, "book", 2.0), (2, "movie", 1.0), (3, "movie", 0.0)]
    lexicon = spark.createDataFrame([("t", f"w{i}") for i in range(10_005)], "tag string, term string").coalesce(1)
    words = spark.createDataFrame([(1, "w3 w10004"), (2, "w10001 x")], "doc_id long, text string")
    assert sorted(map(tuple, lexicon_tags(words, lexicon).collect())) == [(1, "t", 2), (2, "t", 1)]
    categories = spark.createDataFrame([("c", ["a", "b", "c"])], "category string, terms array<string>")
    assert requests(categories, spark.range(1200)).count() == 2400


def test_small_rule_tables_are_broadcast(spark):
    from tesserine.sources.tables import rule_table

    plan = detect_by_patterns(spark.range(10).selectExpr("id as rec", "string(id) as key"), rule_table(spark, PATTERNS, "media_type", "pattern", "weight"))._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan
