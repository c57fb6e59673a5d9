"""Reading and writing of record tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names for checkpoints; only in local mode, where it names none, in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tesserine-{name}-{uuid.uuid4().hex}"


def load_records(spark: SparkSession, path: str, schema: str | None = None, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(items, rejected) of JSON files that each hold an array of objects or one.

    With a schema, keys that it doesn't declare stay in `raw`, the item's own
    JSON.  Items that don't parse or lack a required field are rejected, with
    their text and the reason.
    """
    if schema is None:
        items = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
        bad = F.col("_corrupt").isNotNull() if "_corrupt" in items.columns else F.lit(False)
        lacking = _lacking(items, required)
        out = items.drop("_corrupt")
        return out.where(~bad & (lacking == "")), items.where(bad | (lacking != "")).select(F.when(bad, F.col("_corrupt") if "_corrupt" in items.columns else F.lit(None)).otherwise(F.to_json(F.struct("*"))).alias("raw"), F.when(bad, "not JSON").otherwise(lacking).alias("reason"))
    files = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("body"))
    # An item of its own file is an array of one; each is parsed again by the schema from its own text.
    listed = F.when(F.startswith("body", F.lit("[")), F.col("body")).otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    texts = files.withColumn("all", F.from_json(listed, "array<string>", {"mode": "PERMISSIVE"}))
    parsed = texts.select("body", F.explode_outer("all").alias("raw"))
    rows = parsed.select(F.coalesce("raw", "body").alias("raw"), F.from_json("raw", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    items = rows.select("raw", "x.*")
    bad = F.col("x").isNull() | F.col("x._corrupt").isNotNull()
    lacking = _lacking(items.drop("raw", "_corrupt"), required, "x.")
    good = rows.where(~bad & (lacking == "")).select("x.*", "raw").drop("_corrupt")
    return good, rows.where(bad | (lacking != "")).select("raw", F.when(bad, "not JSON").otherwise(lacking).alias("reason"))


def _lacking(items: DataFrame, required: Sequence[str], prefix: str = "") -> F.Column:
    """The required fields that an item lacks, as a reason."""
    absent = [F.when(F.col(f"{prefix}{c}").isNull(), F.lit(c)) if c in items.columns else F.lit(c) for c in required]
    names = F.array_join(F.array_compact(F.array(*absent)), ", ") if absent else F.lit("")
    return F.when(names != "", F.concat(F.lit("without "), names)).otherwise("")


def latest(items: DataFrame, fields: list[str], order: str, limit: int | None = None, **equal) -> DataFrame:
    """Chosen fields of the items of a kind, newest first."""
    for k, v in equal.items():
        items = items.where(F.col(k) == v)
    out = items.select(*fields).orderBy(F.col(order).desc(), *[c for c in fields if c != order])
    return out.limit(limit) if limit else out


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The target with, for each key in changes, its newest change in place of the old row; of equally new ones, the largest by its other columns."""
    rest = [F.col(c) for c in changes.columns if c not in (key, order)]
    newest = changes.groupBy(key).agg(F.max(F.struct(F.col(order), *rest)).alias("__x")).select(key, "__x.*").select(*changes.columns)
    return target.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def stamped(items: DataFrame, media_type: str, version: str = "2.0", now=None) -> DataFrame:
    """Items with their ingestion columns; `now` is a parameter, so results don't depend on the clock."""
    return items.withColumns({"_ingested_at": F.lit(now).cast("timestamp"), "_media_type": F.lit(media_type), "_enrichment_version": F.lit(version)})


def write_routed(items: DataFrame, path: str, by: str = "_media_type") -> None:
    """A folder for each media type."""
    items.write.mode("append").partitionBy(by).parquet(path)


def with_options(items: DataFrame, metadata: bool = True, confidences: bool = True, timings: bool = True) -> DataFrame:
    """Items with or without metadata (_metadata), confidences (*_confidence) and timings (*_time_ms)."""
    gone = [c for c in items.columns if not metadata and c == "_metadata" or not confidences and c.endswith("_confidence") or not timings and c.endswith("_time_ms")]
    return items.drop(*gone)


def as_json(items: DataFrame, omit_nulls: bool = True) -> DataFrame:
    """One JSON text a row, with or without null fields."""
    return items.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(omit_nulls).lower()}).alias("json"))


def rule_table(spark: SparkSession, rows: Sequence[tuple], *names: str) -> DataFrame:
    """A table of fixed rules whose size Spark knows, so that it is broadcast where it is small."""
    return spark.createDataFrame(pa.table([pa.array(c) for c in zip(*rows)], names=list(names)))
