import random

from pyspark.sql import functions as F
from tesserine.operators import text_index as x


def test_search_is_that_of_all_postings_and_skips_blocks(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    docs = [(i, " ".join(r.choice(words[: 400 if i % 3 else 20]) for _ in range(12)), r.choice(["srca", "srcb"])) for i in range(600)]
    docs += [(1000 + i, " ".join(words[300 + i : 310 + i]), None) for i in range(20)] + [(None, "wordaa", "srca"), (5000, None, None), (5001, "", "srca")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as token", "2 as block")
    queries = [(i, " ".join(words[300 + i : 310 + i])) for i in range(12)] + [(50, "absent words"), (51, None), (52, "wordaa wordab srca")]
    q = spark.createDataFrame(queries, "query_id long, text string")
    x.write_index(df, str(tmp_path / "index"), "doc_id", {"text": 1.0, "source": 2.0}, block=4)
    index = x.read_index(spark, str(tmp_path / "index"))

    def want(query, k, allowed):
        tokens = set((query or "").split())
        scored = [(-sum(1.0 for t in set((text or "").split()) if t in tokens) - (2.0 if source in tokens else 0), i) for i, text, source in docs if i is not None and allowed(i)]
        return [(i, -s) for s, i in sorted(s for s in scored if s[0] < 0)[:k]]

    for k, allowed, sent in ((5, None, x.SENT), (5, None, 0), (3, spark.range(0, 6000, 2).toDF("doc_id"), x.SENT)):
        monkeypatch.setattr(x, "SENT", sent)
        found = {}
        for row in x.indexed_search(index, q, k, allowed, seeds=2).orderBy("query_id", "rank").collect():
            found.setdefault(row.query_id, []).append((row.id, row.score))
        for i, text in queries:
            assert found.get(i, []) == want(text, k, lambda d: allowed is None or d % 2 == 0)
    report = {r.query_id: (r.blocks, r.read) for r in x.blocks_read(index, q, 3, 2).collect()}
    assert all(read <= blocks for blocks, read in report.values()) and sum(read for _, read in report.values()) < 0.5 * sum(blocks for blocks, _ in report.values())


def test_contains_join(spark):
    r = random.Random(2)
    texts = [(i, "".join(r.choice("abcdEé ") for _ in range(r.choice([0, 1, 2, 3, 9, 40])))) for i in range(300)] + [(900, None), (901, "ab" * 30000), (901, "ab" * 30000), (902, "aXb")]
    terms = ["a", "ab", "abc", "É", "bcde", "DE a", "zzz", "", None, "ab", "x", "abababab", "e  "]
    t, w = spark.createDataFrame(texts, "k long, name string"), spark.createDataFrame([(m,) for m in terms], "term string")
    found = x.contains_join(t, w, "name", "term")
    want = sorted((k, name, m) for k, name in texts for m in terms if name is not None and m and m.lower() in name.lower())
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert x.contains_join(t, w.where("false"), "name", "term").collect() == [] == x.contains_join(t.where("false"), w, "name", "term").collect()


def test_contains_join_never_sends_the_grams_of_texts(spark, monkeypatch):
    t = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("name "), F.col("id")).alias("name"))  # Spark knows that this is small
    w = spark.createDataFrame([("7",), ("me 1",)], "term string")
    want = sorted((k, f"name {k}", m) for k in range(100) for m in ("7", "me 1") if m in f"name {k}")
    for sent, join in ((x.SENT, "BuildRight"), (0, "SortMergeJoin")):
        monkeypatch.setattr(x, "SENT", sent)
        found = x.contains_join(t, w, "name", "term")
        assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert join in next(line for line in plan.splitlines() if "Join" in line)


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    x.write_index(empty, str(tmp_path / "none"), "doc_id", {"text": 1.0})
    q = spark.createDataFrame([(1, "any words")], "query_id long, text string")
    assert x.indexed_search(x.read_index(spark, str(tmp_path / "none")), q).collect() == []
    assert x.blocks_read(x.read_index(spark, str(tmp_path / "none")), q).where(F.lit(True)).collect() == []


def test_a_hot_token_has_a_row_for_each_segment(spark, tmp_path, monkeypatch):
    docs = spark.range(0, 5 * x.BLOCKS * 2, numPartitions=1).select("id", F.lit("hot").alias("text"), F.concat(F.lit("own"), F.col("id")).alias("source"))
    x.write_index(docs, str(tmp_path / "index"), "id", {"text": 1.0, "source": 2.0}, block=2)
    index = x.read_index(spark, str(tmp_path / "index"))
    assert index.where("token = 'hot'").count() == 5
    q = spark.createDataFrame([(1, "hot"), (2, "hot own500")], "query_id long, text string")
    found = {}
    for sent in (x.SENT, 0):
        monkeypatch.setattr(x, "SENT", sent)
        found[sent] = sorted((r.query_id, r.rank, r.id, r.score) for r in x.indexed_search(index, q, 2).collect())
        assert found[sent] == [(1, 1, 0, 1.0), (1, 2, 1, 1.0), (2, 1, 500, 3.0), (2, 2, 0, 1.0)]
    assert {r.query_id: r.blocks for r in x.blocks_read(index, q, 1).collect()} == {1: 5 * x.BLOCKS, 2: 5 * x.BLOCKS}


def test_key_words_are_found_once(spark, tmp_path, monkeypatch):
    plans, of = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or of(df, *a, **k))
    docs = spark.range(3).select(F.col("id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    x.write_index(docs, str(tmp_path / "index"), "id", {"text": 1.0})
    assert plans[0].count("filter(split(") == 1
