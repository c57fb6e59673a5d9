"""Keyword merge and ranking over sources (providers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.tables import table
from .text_jobs import concepts_sql, top_per_group

#: Weight of a keyword by its provider.
WEIGHTS = {"llm": 1.0, "graph": 0.8, "vector": 0.6}
DEFAULT_WEIGHT = 0.5
#: Bytes of texts that a task turns into keywords.
TASK_BYTES = 8 << 20


def normalise_sources(rows: DataFrame) -> DataFrame:
    """rec, provider, pos, keyword: trimmed, lower-cased, empties left out."""
    return rows.withColumn("keyword", F.lower(F.trim("keyword"))).where("keyword <> ''")


def weight_of(provider: str = "provider") -> F.Column:
    return F.coalesce(*(F.when(F.col(provider) == k, v) for k, v in WEIGHTS.items()), F.lit(DEFAULT_WEIGHT))


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with those of a record in one task, so that sums by keyword and the record's ranking need no further shuffle; as they are if they stand so already."""
    return rows if getattr(rows, "_dealt", False) else rows.select("rec", *columns).repartition("rec")


def _summed(rows: DataFrame):
    place = F.struct("provider", "pos")
    return dealt(rows, "provider", "pos", "keyword").groupBy("rec", "keyword").agg(F.count("*").alias("n"), F.countDistinct("provider").alias("sources"), F.sum(weight_of()).alias("score"), F.min(place).alias("first"))


def union(rows: DataFrame, most: int = 20) -> DataFrame:
    distinct = rows.select("rec", "keyword").distinct()
    return top_per_group(distinct, ["rec"], ["keyword"], most)


def intersection(rows: DataFrame, min_sources: int | None = None) -> DataFrame:
    """Keywords of all sources of their record, or of at least min_sources."""
    rows = dealt(rows, "provider", "keyword").select("rec", "provider", "keyword")
    need = F.lit(min_sources) if min_sources else F.size(F.collect_set("provider").over(Window.partitionBy("rec")))
    found = rows.withColumn("need", need).groupBy("rec", "keyword").agg(F.countDistinct("provider").alias("sources"), F.max("need").alias("need"))
    return found.where(F.col("sources") >= F.col("need")).select("rec", "keyword", "sources")


def weighted(rows: DataFrame, most: int = 20) -> DataFrame:
    return top_per_group(_summed(rows), ["rec"], [F.col("score").desc(), "first", "keyword"], most)


def ranked(rows: DataFrame, most: int = 20) -> DataFrame:
    return top_per_group(_summed(rows), ["rec"], [F.col("n").desc(), "first", "keyword"], most)


def statistics(rows: DataFrame, merged: DataFrame) -> DataFrame:
    given = rows.groupBy("rec").agg(F.countDistinct("provider").alias("sources"), F.count("*").alias("given"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))
    return given.join(merged.groupBy("rec").agg(F.count("*").alias("final")), "rec", "left").fillna(0, ["final"])


def merge_statistics(rows: DataFrame, most: int = 20) -> DataFrame:
    """The statistics of a union, of whatever providers, from one pass over the keywords."""
    once = dealt(rows, "provider", "keyword").groupBy("rec", "keyword", "provider").agg(F.count("*").alias("n"))
    # A keyword counts where its first provider stands; numbers and flags only, so that no sets are kept for each keyword.
    first = F.row_number().over(Window.partitionBy("rec", "keyword").orderBy("provider")) == 1
    out = once.withColumn("first", first).groupBy("rec", "provider").agg(F.sum("n").alias("n"), F.count_if("first").alias("keywords"))
    out = out.groupBy("rec").agg(F.array_sort(F.collect_set("provider")).alias("named"), F.sum("n").alias("given"), F.sum("keywords").alias("keywords"))  # a few providers
    return out.select("rec", F.size("named").cast("long").alias("sources"), "given", F.array_join("named", ",").alias("providers"), F.least("keywords", F.lit(most)).cast("long").alias("final"))


def borda(rows: DataFrame, most: int = 20) -> DataFrame:
    """Rank fusion: each source gives weight times (its length - rank)."""
    rows = dealt(rows, "provider", "pos", "keyword")
    n = F.count("*").over(Window.partitionBy("rec", "provider"))
    rank = F.row_number().over(Window.partitionBy("rec", "provider").orderBy("pos"))
    scored = rows.withColumn("points", weight_of() * (n - rank)).groupBy("rec", "keyword").agg(F.round(F.sum("points"), 6).alias("score"))
    return top_per_group(scored, ["rec"], [F.col("score").desc(), "keyword"], most)


def factor_ranked(rows: DataFrame, most: int = 20) -> DataFrame:
    """0.4 provider weight + 0.3 frequency + 0.3 mean confidence, the first two relative to the record's largest."""
    per = dealt(rows, "provider", "keyword", "confidence").groupBy("rec", "keyword").agg(F.max(weight_of()).alias("w"), F.count("*").alias("n"), F.avg("confidence").alias("c"))
    w = Window.partitionBy("rec")
    per = per.withColumn("score", F.round(0.4 * F.col("w") / F.max("w").over(w) + 0.3 * F.col("n") / F.max("n").over(w) + 0.3 * F.col("c"), 10))
    return top_per_group(per, ["rec"], [F.col("score").desc(), "keyword"], most)


def combined_weight(field: F.Column, group: F.Column, plugin: F.Column) -> F.Column:
    product = F.coalesce(field, F.lit(1.0)) * F.coalesce(group, F.lit(1.0)) * F.coalesce(plugin, F.lit(1.0))
    return F.least(F.greatest(product, F.lit(0.1)), F.lit(10.0))


def normalised_weights(rows: DataFrame) -> DataFrame:
    """rows with the weight of each provider as its share of those that a record's providers have together."""
    own = rows.select("rec", "provider").distinct().withColumn("w", weight_of())
    total = own.groupBy("rec").agg(F.sum("w").alias("total"))
    return rows.join(total, "rec").withColumn("weight", weight_of() / F.col("total")).drop("total")


def weighted_by(rows: DataFrame, weight: str = "weight", most: int = 20) -> DataFrame:
    """As weighted, by the weights that stand in a column."""
    scored = rows.groupBy("rec", "keyword").agg(F.round(F.sum(weight), 6).alias("score"), F.min(F.struct("provider", "pos")).alias("first"))
    return top_per_group(scored, ["rec"], [F.col("score").desc(), "first", "keyword"], most)


def sources(spark, sf, deal: bool = True) -> DataFrame:
    """Three keyword sources of each document: all key words, all plain long words, and the key words of its longest line.

    Texts are dealt by document before they become words, many times their
    size, so merging shuffles each text once; a task takes TASK_BYTES of them.
    """
    d = table(spark, sf, "documents").select("doc_id", "text")
    if deal:
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        d = d.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)), "doc_id")
    lines = F.split("text", "\n")
    longest = F.array_max(F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), x.alias("line"))))["line"]
    d = d.select("doc_id", "text", longest.alias("longest"))
    plain = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 3)
    placed = lambda p, a: F.transform(a, lambda k, i: F.struct(F.lit(p).alias("provider"), i.alias("pos"), k.alias("keyword")))
    each = F.concat(placed("llm", T.key_words(F.col("text"))), placed("graph", F.array_distinct(plain)), placed("vector", T.key_words(F.col("longest"))))
    rows = d.select(F.col("doc_id").alias("rec"), F.explode(each).alias("x")).select("rec", "x.provider", "x.pos", "x.keyword")
    rows = normalise_sources(rows).withColumn("confidence", F.round(1 / (F.col("pos") + 1), 6))
    rows._dealt = deal
    return rows


_LONGEST = "(SELECT doc_id, (list_max(list_transform(string_split(text, chr(10)), lambda x: {'n': length(x), 'line': x}))).line AS t FROM documents)"
SOURCES_SQL = f"""
SELECT rec, provider, pos, lower(trim(k)) AS keyword, round(1 / (pos + 1), 6) AS confidence FROM (
  SELECT doc_id AS rec, 'llm' AS provider, pos, keyword AS k FROM ({concepts_sql('doc_id', 'text', most=None)})
  UNION ALL SELECT doc_id, 'graph', row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1, k FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS k FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) > 3) AS l FROM documents)) GROUP BY doc_id, k
  UNION ALL SELECT doc_id, 'vector', pos, keyword FROM ({concepts_sql('doc_id', 't', _LONGEST, None)})
) WHERE lower(trim(k)) <> ''"""
_W = "CASE provider WHEN 'llm' THEN 1.0 WHEN 'graph' THEN 0.8 WHEN 'vector' THEN 0.6 ELSE 0.5 END::DOUBLE"
SUMMED_SQL = f"SELECT rec, keyword, count(*) AS n, count(DISTINCT provider) AS sources, sum({_W}) AS score, min({{'provider': provider, 'pos': pos}}) AS first FROM ({SOURCES_SQL}) GROUP BY 1, 2"


def _top(inner: str, order: str, columns: str, n: int = 20) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY {order}) AS rank FROM ({inner})) WHERE rank <= {n}"


def _long(df, *c):
    return df.select(*c, F.col("rank").cast("long").alias("rank"))


QUERIES = {
    "h1_sources": lambda s, d: sources(s, d, False).select("rec", "provider", F.col("pos").cast("long").alias("pos"), "keyword"),
    "h2_union": lambda s, d: _long(union(sources(s, d)), "rec", "keyword"),
    "h3_intersection": lambda s, d: intersection(sources(s, d)),
    "h4_weighted": lambda s, d: _long(weighted(sources(s, d)).withColumn("score", F.round("score", 6)), "rec", "keyword", "score"),
    "h5_ranked": lambda s, d: _long(ranked(sources(s, d)), "rec", "keyword", "n"),
    "h6_statistics": lambda s, d: merge_statistics(sources(s, d)),
    "h7_min_sources": lambda s, d: intersection(sources(s, d), 2),
    "h7_normalised_weights": lambda s, d: _long(weighted_by(normalised_weights(sources(s, d).where("provider <> 'llm' or rec % 3 > 0"))), "rec", "keyword", "score"),
    "h7_factors": lambda s, d: _long(factor_ranked(sources(s, d)), "rec", "keyword", "score"),
    "h9_borda": lambda s, d: _long(borda(sources(s, d)), "rec", "keyword", "score"),
    "h8_weights": lambda s, d: table(s, d, "part").select("p_partkey", F.round(combined_weight(F.col("p_size") / 10, F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice") / 1000), F.lit(None).cast("double")), 6).alias("weight")),
}
ORACLES = {
    "h1_sources": f"SELECT rec, provider, pos, keyword FROM ({SOURCES_SQL})",
    "h2_union": _top(f"SELECT DISTINCT rec, keyword FROM ({SOURCES_SQL})", "keyword", "rec, keyword, rank"),
    "h3_intersection": f"SELECT rec, keyword, sources FROM ({SUMMED_SQL}) JOIN (SELECT rec, count(DISTINCT provider) AS a FROM ({SOURCES_SQL}) GROUP BY 1) USING (rec) WHERE sources >= a",
    "h4_weighted": _top(SUMMED_SQL, "round(score, 6) DESC, first, keyword", "rec, keyword, round(score, 6) AS score, rank"),
    "h5_ranked": _top(SUMMED_SQL, "n DESC, first, keyword", "rec, keyword, n, rank"),
    "h6_statistics": f"SELECT rec, count(DISTINCT provider) AS sources, count(*) AS given, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, least(count(DISTINCT keyword), 20) AS final FROM ({SOURCES_SQL}) GROUP BY 1",
    "h7_min_sources": f"SELECT rec, keyword, sources FROM ({SUMMED_SQL}) WHERE sources >= 2",
    "h7_normalised_weights": _top(f"WITH r AS (SELECT * FROM ({SOURCES_SQL}) WHERE provider <> 'llm' OR rec % 3 > 0), t AS (SELECT rec, sum(w) AS total FROM (SELECT DISTINCT rec, provider, {_W} AS w FROM r) GROUP BY 1) SELECT rec, keyword, round(sum({_W} / total), 6) AS score, min({{'provider': provider, 'pos': pos}}) AS first FROM r JOIN t USING (rec) GROUP BY 1, 2", "score DESC, first, keyword", "rec, keyword, score, rank"),
    "h7_factors": _top(f"SELECT rec, keyword, round(0.4 * w / max(w) OVER (PARTITION BY rec) + 0.3 * n / max(n) OVER (PARTITION BY rec) + 0.3 * c, 10) AS score FROM (SELECT rec, keyword, max({_W}) AS w, count(*) AS n, avg(confidence) AS c FROM ({SOURCES_SQL}) GROUP BY 1, 2)", "score DESC, keyword", "rec, keyword, score, rank"),
    "h9_borda": _top(f"SELECT rec, keyword, round(sum(p), 6) AS score FROM (SELECT *, {_W} * (count(*) OVER (PARTITION BY rec, provider) - row_number() OVER (PARTITION BY rec, provider ORDER BY pos)) AS p FROM ({SOURCES_SQL})) GROUP BY 1, 2", "score DESC, keyword", "rec, keyword, score, rank"),
    "h8_weights": "SELECT p_partkey, round(least(greatest(p_size / 10 * CASE WHEN p_size % 3 <> 0 THEN p_retailprice / 1000 ELSE 1.0 END, 0.1), 10.0), 6) AS weight FROM part",
}
