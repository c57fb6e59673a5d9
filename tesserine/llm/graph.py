"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to the smallest node among it and its neighbours.

    The smallest neighbour comes from a pre-aggregated minimum, so a node with
    very many neighbours is never gathered in one place; the join that hands it
    back is one that Spark may split where a node is hot.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if large:
        moved = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = both.where("v < u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        moved = down.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for each node of the edges (columns a and b).

    The number of rounds grows with the logarithm of the longest path.  Each
    round is written to the shared folder, so a lost executor costs no more than
    a reread.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    mark = None
    while True:
        after = written(_star(written_step := written(_star(now, True), "edges"), False), "edges")
        found = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(spark, written_step, now)
        now = after
        if tuple(found) == mark:
            break
        mark = tuple(found)
    # What is left are stars: each node once, below its smallest.
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
