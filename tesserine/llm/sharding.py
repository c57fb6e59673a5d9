"""Minimax contiguous sharding of atomic groups, in DataFrame operations only.

Groups of equal texts are ordered by the digest of their text.  Shards are runs
of that order.  The smallest capacity with which a greedy walk needs no more
than the given number of shards is found by binary search, and the greedy cuts
at that capacity are the shards, so that the largest shard is as small as any
cutting into runs allows (law ``bytes``).

The walk runs on the driver over sums of at most 65,536 stretches of the order,
those of the digests that begin alike.  A stretch of several groups into which a
cut falls is opened: the table is read once more for the sums of its parts.  A
capacity is too small if even cutting anywhere within stretches doesn't do, and
large enough if cutting between them does; a few stretches are opened until both
bounds meet and every cut stands between groups.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import dropped, written

#: Hexadecimal digits of a digest that stretches have at first, and more that they have when they are opened.
DIGITS, MORE = 4, 2
#: Stretches on either side that are opened together with one that a cut falls into.
AROUND = 4


class Stretches:
    """The order as runs of groups: for each, bytes, its last group, and whether it is a single one."""

    def __init__(self, rows: list[tuple[str, int, str, bool]]):
        self.rows = sorted(rows)  # (first digits, bytes, last group, single)
        self.ends = [0, *accumulate(r[1] for r in self.rows)]

    def walk(self, capacity: int, n_shards: int, anywhere: bool = False) -> tuple[list[int], list[int]]:
        """Ends of the shards by the greedy walk, and the stretches of several groups that cuts fall into; those are cut at the capacity itself (anywhere) or before them."""
        ends, inside = [0], []
        for _ in range(n_shards):
            reach = ends[-1] + capacity
            i = bisect_right(self.ends, reach) - 1  # the last end within reach
            if i < len(self.rows) and self.ends[i] < reach and not self.rows[i][3]:
                inside.append(i)
                ends.append(reach if anywhere else max(ends[-1], self.ends[i]))
            else:
                ends.append(max(ends[-1], self.ends[i]))
        return ends[1:], inside

    def smallest(self, n_shards: int, anywhere: bool) -> int:
        """The smallest capacity with which the walk covers everything."""
        low, high = -(-self.ends[-1] // n_shards), self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, n_shards, anywhere)[0][-1] >= self.ends[-1]:
                high = mid
            else:
                low = mid + 1
        return low


def _stretches(groups: DataFrame, digits: int) -> list[tuple[str, int, str, bool]]:
    """Sums of the runs of digests that agree in so many digits: at most 16 ** DIGITS of all, or of the few that are opened."""
    rows = groups.groupBy(F.substring("group", 1, digits).alias("head")).agg(F.sum("bytes").alias("bytes"), F.min("group").alias("low"), F.max("group").alias("high"))
    return [(r["head"], r["bytes"], r["high"], r["low"] == r["high"]) for r in rows.collect()]


def cuts(groups: DataFrame, n_shards: int, digits: int = DIGITS) -> tuple[int, list[str]]:
    """(smallest feasible capacity, last group of each shard but the last, "" before the first group) for a table of groups with columns group and bytes; a group may have several rows."""
    now = Stretches(_stretches(groups, digits))
    while True:
        enough = now.smallest(n_shards, anywhere=False)
        ends, inside = now.walk(enough, n_shards)
        least = now.smallest(n_shards, anywhere=True)
        if least == enough and not inside:
            at = [bisect_right(now.ends, e) - 1 for e in ends[:-1]]
            return enough, [now.rows[i - 1][2] if i else "" for i in at]
        hit = {i for k in (*inside, *now.walk(least, n_shards, True)[1]) for i in range(k - AROUND, k + AROUND + 1)}
        opened = [now.rows[i] for i in sorted(hit) if 0 <= i < len(now.rows) and not now.rows[i][3]]
        kept = [r for r in now.rows if r not in opened]
        for size in {len(r[0]) for r in opened}:
            heads = [r[0] for r in opened if len(r[0]) == size]
            kept += _stretches(groups.where(F.substring("group", 1, size).isin(heads)), size + MORE)
        now = Stretches(kept)


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    Size: UTF-8 bytes plus 1; a null text has none and goes with the empty
    texts.  Slots number the rows of a shard without gaps in the order of text
    digest, digest of the id (two digits) and id; repeated rows get slots of
    their own, null ids are allowed.  Other columns of docs are not read,
    whatever their names.  An empty table gives an empty result.  grown_shard is
    null: the law is ``bytes``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 2)  # deals the rows of one group
    rows = written(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group"), salt.alias("salt")), "shard-rows")
    parts = written(rows.groupBy("group", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-parts")

    _, last = cuts(parts, n_shards, digits)
    shard = sum((F.when(F.col("group") > g, 1).otherwise(0) for g in last), F.lit(0)).cast("int")
    parts = parts.withColumns({"shard": shard, "head": F.substring("group", 1, digits)})

    # Rows before each stretch of a shard (at most 16 ** DIGITS and the shards' edges), then within the stretch.
    heads = parts.groupBy("shard", "head").agg(F.sum("rows").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("shard", "head", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "head").orderBy("group", "salt").rowsBetween(Window.unboundedPreceding, -1)
    places = parts.withColumn("within", F.coalesce(F.sum("rows").over(within), F.lit(0))).join(heads, ["shard", "head"]).select("group", "salt", "shard", (F.col("before") + F.col("within")).alias("at"))
    number = F.row_number().over(Window.partitionBy("group", "salt").orderBy(F.col("doc_id").asc_nulls_first()))
    out = rows.withColumn("n", number).join(places, ["group", "salt"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)


def _oracle(n_shards: int = 8) -> str:
    """Equal texts in the order of their digests; least largest run for each number of runs by comparing all last cuts; greedy cuts at that capacity."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    crc = f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"
    ctes = [
        "d AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS g, strlen(coalesce(text, '')) + 1 AS size FROM documents)",
        "groups AS (SELECT g, sum(size)::BIGINT AS bytes, sum(sum(size)) OVER (ORDER BY g)::BIGINT AS upto FROM d GROUP BY g)",
        "ends AS (SELECT 0::BIGINT AS e UNION ALL SELECT upto FROM groups)",
        "best1 AS (SELECT e, e AS c FROM ends)",
        *(f"best{k} AS (SELECT b.e, min(greatest(a.c, b.e - a.e)) AS c FROM best{k - 1} a JOIN ends b ON a.e <= b.e GROUP BY b.e)" for k in range(2, n_shards + 1)),
        f"cap AS (SELECT arg_max(c, e) AS c FROM best{n_shards})",
        "cut0 AS (SELECT 0::BIGINT AS e)",
        *(f"cut{k} AS (SELECT max(ends.e) AS e FROM ends, cut{k - 1} p, cap WHERE ends.e <= p.e + cap.c)" for k in range(1, n_shards)),
        "sharded AS (SELECT g, " + " + ".join(f"(upto > (SELECT e FROM cut{k}))::INT" for k in range(1, n_shards)) + " AS shard FROM groups)",
    ]
    return f"WITH {', '.join(ctes)} SELECT doc_id, size::BIGINT AS size, CASE WHEN t = '' THEN 0 ELSE {crc} END::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY g, md5(doc_id::VARCHAR)[1:2], doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM d JOIN sharded USING (g)"


QUERIES = {"op8_minimax_shards": op8_minimax_shards}
ORACLES = {"op8_minimax_shards": _oracle()}
