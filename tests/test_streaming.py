import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tesserine.operators.telemetry import breaker, checks
from tesserine.sources.tables import upsert
from tesserine.streaming import jobs as j

EVENTS = "/root/testdata/sf0.001/events.parquet"


def landed(spark, tmp_path, n=3):
    """The events in n files, in order of time."""
    events = spark.read.parquet(EVENTS)
    folder = str(tmp_path / "in")
    cut = [r[0] for r in events.selectExpr(f"percentile(unix_timestamp(cast(ts as timestamp)), array({','.join(str(i / n) for i in range(1, n))})) as q").selectExpr("explode(q)").collect()]
    part = sum((F.when(F.unix_timestamp(F.col("ts").cast("timestamp")) > c, 1).otherwise(0) for c in cut), F.lit(0))
    for i in range(n):
        events.where(part == i).coalesce(1).write.mode("append").parquet(folder)
    return events, j.events_stream(spark, folder, events.schema)


def ran(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_windows_equal_batch(spark, tmp_path):
    events, stream = landed(spark, tmp_path)
    got = ran(j.rates(stream), "rates", "complete")
    assert sorted(map(tuple, got.select("start", "event_type", "n", "errors").collect())) == sorted(map(tuple, j.rates(events).select("start", "event_type", "n", "errors").collect()))


def replayed(spark, tmp_path, events, name, failures, idle_s, late):
    """States by the stream over the events in files, the last of which moves the watermark past all others."""
    end = events.agg(F.max("ts").cast("timestamp").alias("t")).first().t
    last = spark.createDataFrame([(-1, end + timedelta(days=40), -1, "view", 1.0)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    folder = str(tmp_path / "in")
    last.withColumn("ts", F.col("ts").cast(events.schema["ts"].dataType)).select(*(F.col(c).cast(events.schema[c].dataType) for c in last.columns)).coalesce(1).write.mode("append").parquet(folder)
    stream = j.events_stream(spark, folder, events.select(*last.columns).schema)
    return {r.id: r.state for r in ran(j.breaker_states(stream, failures, idle_s, late), name, "append").collect() if r.id >= 0}


def test_breaker_equals_batch(spark, tmp_path):
    events, _ = landed(spark, tmp_path)
    got = replayed(spark, tmp_path, events, "breaker", 2, 3600.0, "1 second")
    assert got == {r.id: r.state for r in breaker(checks(events), 2, 3600).collect()}


def test_breaker_takes_late_rows_in_order_and_a_hot_service(spark, tmp_path):
    """Rows of a third of one service come in four files, each mixed with rows up to two hours older."""
    r = random.Random(3)
    at = datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        at += timedelta(seconds=r.choice((0, 0, 20, 60, 400)))
        rows.append((i, at, r.choice((1, 1, 2, 3)), r.choice(("error", "view")), 1.0))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    order = sorted(rows, key=lambda x: x[1] + timedelta(seconds=r.random() * 7200))
    for k in range(4):
        spark.createDataFrame(order[k * 375 : (k + 1) * 375], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = replayed(spark, tmp_path, events, "late", 3, 60.0, "3 hours")
    want = {x.id: x.state for x in breaker(checks(events), 3, 60).collect()}
    assert got == want and len(set(want.values())) == 3


def test_lines_are_accepted_retried_or_dead_even_if_a_batch_is_repeated(spark, tmp_path):
    docs = spark.range(90).selectExpr("case id % 6 when 0 then concat('{\"Id\":', id, ',\"Name\":\"n\",\"any\":[1]}') when 1 then concat('{\"Id\":', id) when 2 then concat('{\"Id\":', id, ',\"_attempts\":', id % 5, '}') when 3 then '[]' when 4 then '' else concat('{\"Name\":\"', id, '\"}') end as raw", "id % 3 as part")
    for k in range(3):
        docs.where(F.col("part") == k).select("raw").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    stream = j.ingested_routes(j.json_lines_stream(spark, str(tmp_path / "in")))
    for checkpoint in ("ck", "again"):  # a new checkpoint repeats all batches
        q = j.routed_batches(stream, str(tmp_path / "out"), str(tmp_path / checkpoint))
        q.awaitTermination(120)
        assert q.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() == 3
    got = {r.route: r.n for r in out.groupBy("route").agg(F.count("*").alias("n")).collect()}
    tried = [k % 5 for k in range(90) if k % 6 == 2]
    assert sum(got.values()) == 90 and got["accepted"] == 15
    assert got["retry"] == sum(x < 3 for x in tried) + 30 and got["dead_letter"] == sum(x >= 3 for x in tried) + 30


def test_bucketed_upserts_rewrite_what_they_touch(spark, tmp_path):
    schema = "cache_key string, value long, at long"
    for k in range(3):
        keys = range(200) if k == 0 else (5, 7, 1000 + k)
        spark.createDataFrame([(f"k{i}", i + k, k) for i in keys], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    # Cache first: what is known stays, what is new comes in.
    cached = lambda before, batch: before.unionByName(batch.join(before, "cache_key", "left_anti"))
    newest = lambda before, batch: upsert(before, batch, "cache_key", "at")
    for name, merge in (("first", cached), ("newest", newest)):
        path = str(tmp_path / name)
        for checkpoint in ("ck", "again"):
            q = j.bucketed_upserts(stream, path, "cache_key", merge, f"{path}-{checkpoint}", 16)
            q.awaitTermination(120)
            assert q.exception() is None
        got = {r.cache_key: (r.value, r.at) for r in j.bucketed_snapshot(spark, path, schema).collect()}
        want = {f"k{i}": (i, 0) for i in range(200)} | {"k1001": (1002, 1), "k1002": (1004, 2)}
        assert got == (want if name == "first" else want | {"k5": (7, 2), "k7": (9, 2)})
        written = [r.batch for r in spark.read.parquet(f"{path}/manifests/batch=2").collect()]
        touched = spark.createDataFrame([(k,) for k in ("k5", "k7", "k1002")], "k string").select(F.pmod(F.xxhash64("k"), F.lit(16))).distinct().count()
        assert len(written) == 16 and written.count(2) == touched and written.count(0) >= 16 - 2 * 3
        assert len(list((tmp_path / name / "data" / "batch=2").glob("bucket=*"))) == touched


def test_upserts_by_batch(spark, tmp_path):
    events, stream = landed(spark, tmp_path)
    merge = lambda before, batch: batch.transform(lambda b: upsert(before if before is not None else b.limit(0), b, "user_id", "ts"))
    q = j.upsert_batches(stream, str(tmp_path / "out"), merge, str(tmp_path / "ck"))
    q.awaitTermination(120)
    last = max(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))
    got = {r.user_id: r.ts for r in spark.read.parquet(str(tmp_path / "out" / last)).collect()}
    assert got == {r.user_id: r.ts for r in events.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}


def test_once(spark, tmp_path):
    events, stream = landed(spark, tmp_path)
    assert ran(j.once(stream), "once", "append").count() == events.select("event_id").distinct().count()
