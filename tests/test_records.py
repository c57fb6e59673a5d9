import json

from pyspark.sql import functions as F
from tesserine.operators import records as r
from tesserine.operators.cache import get_or_compute, purged
from tesserine.operators.detect import detect_by_presence
from tesserine.plans.enrich import Plan, Step, answered
from tesserine.sources.tables import load_records, stamped, write_routed

MOVIE = {"ProductionYear": {"min": 1888, "max": 2030}, "CommunityRating": {"min": 0, "max": 10}, "Genres": {"max_items": 3}, "Name": {}, "Id": {}}
PEOPLE = [("Ann", "Actor"), ("Dee", "Director"), ("Eve", "Director"), ("", "Writer")]


def movies(spark):
    rows = [("a", "1", 2020, 7.5, ["Action"]), ("b", "2", 1800, 7.5, []), ("c", "3", 2050, 1.0, []), ("d", "4", 2000, -1.0, []), ("e", "5", 2000, 15.0, []), (None, None, 2000, 5.0, []), ("g", "7", 1995, 5.0, ["x"] * 4)]
    return spark.createDataFrame(rows, "Name string, Id string, ProductionYear int, CommunityRating double, Genres array<string>")


def test_validation_cases(spark):
    valid, invalid = r.split_valid(movies(spark), MOVIE, ("Name", "Id", "Unknown"))
    assert [x.Name for x in valid.collect()] == ["a"]
    assert {x.Name: x.errors for x in invalid.collect()} == {"b": ["ProductionYear:min"], "c": ["ProductionYear:max"], "d": ["CommunityRating:min"], "e": ["CommunityRating:max"], None: ["Name:required", "Id:required"], "g": ["Genres:max_items"]}


def test_computed_fields(spark):
    df = spark.createDataFrame([(PEOPLE,), ([],), (None,)], "People array<struct<Name:string,Type:string>>")
    one = r.extract("People", {"Type": "Director"}, "Name")
    assert [x[0] for x in df.select(one).collect()] == ["Dee", None, None]
    assert [x[0] for x in df.select(r.extract("People", {"Type": "Director"}, "Name", True)).collect()] == [["Dee", "Eve"], None, None]
    assert df.select(r.extract("People", {"Type": "Writer"}, "Name")).first()[0] is None


def test_json_items(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"Name": "x", "Id": "1"}))
    (tmp_path / "two.json").write_text(json.dumps([{"Name": "y", "Id": "2", "Extra": 3}, {"Name": "z", "Id": "3"}]))
    items, rejected = load_records(spark, str(tmp_path))
    assert {(i.Name, i.Id) for i in items.collect()} == {("x", "1"), ("y", "2"), ("z", "3")} and rejected.collect() == []
    out = str(tmp_path / "out")
    write_routed(stamped(items, "movie", now="2024-01-01"), out)
    assert spark.read.parquet(out).where("_media_type = 'movie' and _enrichment_version = '2.0'").count() == 3


def test_undeclared_keys_and_rejected_items(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"Name": "y", "Id": "2", "Extra": [3, {"k": 1}]}, {"Id": "3"}, 7]))
    (tmp_path / "b.json").write_text("{ not json")
    (tmp_path / "c.json").write_text(json.dumps({"Name": "z", "Id": "4", "Extra": None}))
    items, rejected = load_records(spark, str(tmp_path), "Name string, Id string", ["Name"])
    assert {i.Id: json.loads(i.raw).get("Extra") for i in items.collect()} == {"2": [3, {"k": 1}], "4": None}
    assert sorted((r.raw, r.reason) for r in rejected.collect()) == [("7", "not JSON"), ('{ not json', "not JSON"), ('{"Id":"3"}', "without Name")]


def test_profile_cascade(spark):
    values = {"A readable overview of it": "TEXT_CONTENT", "1994": "METADATA", "8,5": "METADATA", "http://a.b/1234567890123456": "IDENTIFIERS", "0123456789abcdef01234": "IDENTIFIERS", "?": "UNKNOWN"}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {x.v: x.k for x in df.select("v", r.classified(F.col("v")).alias("k")).collect()} == values


def test_presence_rules(spark):
    keys = lambda *k: spark.range(1).select(detect_by_presence(F.array(*map(F.lit, k)))).first()[0]
    assert [keys("album"), keys("isbn"), keys("episode"), keys("x"), keys("movie_id", "album")] == ["music", "book", "tv_show", "movie", "movie"]


def test_cache_strategies(spark):
    cache = spark.createDataFrame([("k1", "t", [1], 50.0, 1.0), ("k2", "t", [2], 500.0, 1.0)], "cache_key string, type string, result array<int>, expires_at double, created_at double")
    asked = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "c"), ("k3", "c")], "cache_key string, concept string")
    compute = lambda m: m.select("cache_key", F.lit("new").alias("type"), F.array(F.lit(9)).alias("result"))
    got = lambda s: {x.cache_key: x.result for x in get_or_compute(asked, cache, compute, 100.0, s)[0].collect()}
    assert got("CACHE_FIRST") == {"k1": [9], "k2": [2], "k3": [9]}
    assert got("CACHE_ONLY") == {"k2": [2]}
    assert got("REFRESH") == got("BYPASS") == {"k1": [9], "k2": [9], "k3": [9]}
    assert [x.cache_key for x in purged(cache, now=100.0).collect()] == ["k2"]
    assert [x.cache_key for x in purged(cache, prefix="k2").collect()] == ["k1"]


def test_compiled_plan_and_model_requests(spark):
    import pyarrow as pa

    plan = Plan(constraints=MOVIE, required=("Name",), enrichments=[Step("loud", ("Name",), F.upper)], prompts={"prompt": "Ask {Name} {loud}"})
    assert plan.apply(movies(spark)).where("Id = '1'").select("prompt").first()[0] == "Ask a A"

    def model(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.upper() for p in b.column(1).to_pylist()])], names=["cache_key", "answer"])

    asked = spark.createDataFrame([("k", "x"), ("k", "x"), ("c", "y")], "cache_key string, prompt string")
    assert [tuple(x) for x in answered(asked, model, "cache_key string, answer string", asked.where("cache_key = 'c'")).collect()] == [("k", "X")]


def test_nested_texts_are_folded_in_the_jvm(spark):
    from tesserine.operators import nested

    row = ("\u00e9", [("\u00e9\u00e9", 1), None], {"caf\u00e9": ["\u00fc", None], "x": None}, None)
    given = spark.createDataFrame([row, (None,) * 4], "`na\u00efve` string, who array<struct<n:string,k:int>>, ids map<string,array<string>>, s struct<a:string>")
    df = nested.normalised_records(given.selectExpr("*", "if(who is null, null, map('\u00e9', 1, 'e', 2)) as twice"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in df.collect()]
    assert df.columns[0] == "naive" and got == [("e", [("ee", 1), None], {"cafe": ["u", None], "x": None}, None, {"e": 2}), (None,) * 5]
