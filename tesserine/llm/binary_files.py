"""Files of binary records, written and read by Spark wherever its file systems reach.

Each record of a task's rows goes to the task's file, one after another, with a
fixed separator after each.  The bytes pass unchanged: the writer takes them as
the raw bytes of a string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, separator: bytes, most: int = 0) -> None:
    """Writes the binary column `record` of each row, in the order of the rows of each partition, to one file a partition, or to several of `most` records."""
    lines = records.select(F.col("record").cast("string").alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).option("maxRecordsPerFile", most).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each file that write_records made, a row a file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > 0).select("path", "content")
