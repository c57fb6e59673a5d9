"""Streams: event-time windows, ingestion with dedup and quarantine, upserts by batch and by bucket, breaker state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.open_records import parsed
from ..operators.telemetry import checks


def events_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Parquet files that land in a folder, `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def rates(events: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Requests and errors by event-time window and type; rows later than the watermark are dropped."""
    c = checks(events).withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return c.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"), F.percentile_approx("ms", F.array(F.lit(0.5), F.lit(0.95))).alias("q")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "errors", "q")


def once(events: DataFrame, key: str = "id", late: str = "10 minutes") -> DataFrame:
    """Each record once within the watermark."""
    return checks(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


class Breaker(StatefulProcessor):
    """Circuit of one service: rows wait until the watermark has passed them, then a timer takes those of its millisecond in order of time and id.

    State: the circuit, and the waiting rows by millisecond; what waits is what
    the watermark may still precede.
    """

    def __init__(self, failures: int, idle_s: float):
        self.failures, self.idle_us = failures, int(idle_s * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.circuit = handle.getValueState("circuit", "now string, run long, last long")
        self.waiting = handle.getMapState("waiting", "at long", "us array<long>, id array<long>, ok array<boolean>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            at = (r.us // 1000,)
            us, ids, oks = self.waiting.getValue(at) if self.waiting.containsKey(at) else ([], [], [])
            if not ids:
                self.handle.registerTimer(at[0])
            self.waiting.updateValue(at, ([*us, r.us], [*ids, r.id], [*oks, r.ok]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = (expiredTimerInfo.getExpiryTimeInMs(),)
        rows = sorted(zip(*self.waiting.getValue(at)))
        self.waiting.removeKey(at)
        now, run, last = self.circuit.get() if self.circuit.exists() else ("CLOSED", 0, 0)
        for us, i, ok in rows:
            if now == "OPEN" and us - last >= self.idle_us:
                now = "HALF_OPEN"
            if ok:
                now, run = "CLOSED", 0
            else:
                run, last = run + 1, us
                if now == "CLOSED" and run >= self.failures:
                    now = "OPEN"
            yield Row(service=key[0], id=i, state=now)
        self.circuit.update((now, run, last))

    def close(self) -> None:
        pass


def breaker_states(events: DataFrame, failures: int = 5, idle_s: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """Circuit state after each check, kept by service across batches, as the batch replay tells it.

    A check is answered when the watermark has passed it; those that come later
    than that are dropped.  Checks without time or id are left out.  State is
    kept in RocksDB, which the session must use for stateful streams.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = checks(events).where("ts is not null and id is not null").withWatermark("ts", late)
    rows = rows.select("service", "ts", F.unix_micros("ts").alias("us"), "id", F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.groupBy("service").transformWithState(statefulProcessor=Breaker(failures, idle_s), outputStructType="service long, id long, state string", outputMode="Append", timeMode="EventTime")


def json_lines_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """raw: the lines of text files that land in a folder, `files` a batch."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder).withColumnRenamed("value", "raw")


def ingested_routes(lines: DataFrame, required: tuple[str, ...] = ("Id", "Name"), attempts: str = "$._attempts", most: int = 3) -> DataFrame:
    """raw, reason, route of JSON lines: accepted, or rejected and then for retry until an item has been tried `most` times, else dead letters.

    What is no JSON can't be mended and is a dead letter at once.
    """
    items = parsed(lines, required)
    tried = F.coalesce(F.try_variant_get("item", attempts, "long"), F.lit(0))
    route = F.when(F.col("reason").isNull(), "accepted").when(F.col("item").isNull() | (tried >= most), "dead_letter").otherwise("retry")
    return items.select("raw", "reason", route.alias("route"))


def routed_batches(rows: DataFrame, path: str, checkpoint: str, by: str = "route") -> StreamingQuery:
    """Each batch written once to folders batch=<n>/<by>=<route>; a batch that is repeated replaces what it wrote, in all routes."""

    def apply(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").partitionBy(by).parquet(f"{path}/batch={n}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """(number of the newest manifest before a batch, the batch that wrote each bucket last); -1 where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return -1, {}
    found = [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    n = max((k for k in found if before is None or k < before), default=-1)
    return n, {r.bucket: r.batch for r in spark.read.parquet(f"{path}/manifests/batch={n}").collect()} if n >= 0 else {}


def bucketed_snapshot(spark: SparkSession, path: str, schema, buckets: list[int] | None = None) -> DataFrame:
    """The table that bucketed_upserts keeps, or some of its buckets."""
    return _read(spark, path, _manifest(spark, path)[1], schema, buckets)


def _read(spark: SparkSession, path: str, newest: dict[int, int], schema, buckets: list[int] | None = None) -> DataFrame:
    paths = [f"{path}/data/batch={n}/bucket={b}" for b, n in sorted(newest.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucketed_upserts(stream: DataFrame, path: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Each batch merged into a table in buckets by a key's hash, of which it rewrites only those it has rows of.

    merge(before, batch) gives the new rows of the touched buckets and keeps the
    batch's columns.  A manifest for each batch names the batch that wrote each
    bucket last; it is written behind the data, and a repeated batch starts from
    the manifest before its own, so it writes the same again.  Versions that
    neither the newest manifest nor the one before it names are deleted.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        batch = batch.persist()
        touched = sorted(r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect())  # at most `buckets` rows
        last, newest = _manifest(spark, path, before=n)
        if touched:
            before = _read(spark, path, newest, batch.schema, touched)
            merge(before, batch).select(*batch.columns, bucket.alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={n}")
        now = newest | dict.fromkeys(touched, n)
        spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/batch={n}")
        batch.unpersist()
        kept = set(now.values()) | set(newest.values())
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in files.listStatus(root) if files.exists(root) else ():
            if int(folder.getPath().getName().split("=")[1]) not in kept:
                files.delete(folder.getPath(), True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Each batch merged with the newest snapshot into the next; a batch that is repeated writes the same snapshot again.

    Snapshots are folders batch=<n>; the newest is the table.  The one before it
    stays for readers and for a repeated batch, older ones are deleted.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/batch={n - 1}") if n else None
        merge(before, batch).write.mode("overwrite").parquet(f"{path}/batch={n}")
        if n > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
