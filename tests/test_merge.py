from tesserine.operators import merge as m


def test_statistics_of_any_provider(spark):
    rows = spark.createDataFrame([(1, "own", 0, "a"), (1, "llm", 0, "a"), (1, "zoo", 1, "b"), (2, "own", 0, "c"), (2, "own", 1, "c")], "rec long, provider string, pos int, keyword string")
    got = sorted(map(tuple, m.merge_statistics(rows).collect()))
    assert got == [(1, 3, 3, "llm,own,zoo", 2), (2, 1, 2, "own", 1)]
    assert got == sorted(map(tuple, m.statistics(rows, m.union(rows)).select("rec", "sources", "given", "providers", "final").collect()))


def test_one_shuffle_ranks_a_record(spark):
    rows = spark.createDataFrame([(i % 7, "llm" if i % 2 else "graph", i, f"k{i % 5}") for i in range(100)], "rec long, provider string, pos int, keyword string")
    for f in (m.weighted, m.ranked, m.borda):
        plan = f(rows)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1


def test_texts_are_dealt_once_before_they_become_words(spark):
    for f in (m.union, m.intersection, m.weighted, m.ranked, m.merge_statistics, m.borda, m.factor_ranked, lambda r: m.intersection(r, 2)):
        plan = f(m.sources(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
