from pyspark.sql import functions as F
from tesserine.operators import expand as x


def test_requests_are_never_sent(spark, monkeypatch):
    requests = spark.range(40).select(F.col("id").alias("request"), F.lit(0).alias("pos"), F.concat(F.lit("k"), F.col("id") % 2).alias("keyword"))  # Spark knows that this is small
    results = spark.createDataFrame([("k0", 1, "a", 0.9), ("k0", 2, "b", 0.8), ("k1", 1, "a", 0.9)], "concept string, rank int, expanded string, confidence double")
    want = sorted((i, n + 1, c) for i in range(40) for n, c in enumerate("ab" if i % 2 == 0 else "a"))
    for most, join in ((x.KEYWORDS, "BuildRight"), (1, "SortMergeJoin")):
        monkeypatch.setattr(x, "KEYWORDS", most)
        for found in (x.multi_keyword(requests, results), x.per_tag(requests.toDF("rec", "pos", "tag"), results)):
            assert sorted(map(tuple, found.collect())) == want
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert join in next(line for line in plan.splitlines() if "Join" in line)
