"""Tables and files in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only in
local mode, where driver and executors are one process, a temporary folder of
this machine serves where that is unset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder; sets one of this machine's only in local mode where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tesserine-shared-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/tesserine/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs a reread, not the whole job again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tesserine_path = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables made by ``written`` (or paths) that no later step reads."""
    for table in tables:
        path = table if isinstance(table, str) else table._tesserine_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
