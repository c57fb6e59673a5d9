"""The expansion cache as a table: keys, look-ups with expiry, incremental refresh, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .text_jobs import key_sql

TTL = 3600.0


def parsed_key(key: F.Column) -> F.Column:
    """The four parts of a key; null where it hasn't four."""
    p = F.split(key, ":")
    return F.when(F.size(p) == 4, F.struct(*(p[i].alias(n) for i, n in enumerate(("type", "field", "value", "context")))))


def live(cache: DataFrame, now: float) -> DataFrame:
    """Entries that have not expired; no expiry or zero never does."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") == 0) | (F.col("expires_at") >= now))


def lookup(requests: DataFrame, cache: DataFrame, now: float) -> DataFrame:
    """requests with hit and the stored result."""
    stored = live(cache, now).select("cache_key", F.col("result").alias("stored"))
    return requests.join(stored, "cache_key", "left").withColumn("hit", F.col("stored").isNotNull())


def get_or_compute(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], now: float, strategy: str = "CACHE_FIRST", ttl: float = TTL) -> tuple[DataFrame, DataFrame]:
    """(results by key, the cache after it).

    Distinct keys that miss are computed once, all together.  CACHE_ONLY computes
    nothing; BYPASS and REFRESH compute all keys and store them.
    """
    wanted = requests.select("cache_key", "concept").dropDuplicates(["cache_key"])
    found = lookup(wanted, cache, now)
    if strategy == "CACHE_ONLY":
        return found.where("hit").select("cache_key", F.col("stored").alias("result")), cache
    missing = wanted if strategy in ("BYPASS", "REFRESH") else found.where("not hit").select("cache_key", "concept")
    new = compute(missing).withColumn("expires_at", F.lit(now + ttl)).withColumn("created_at", F.lit(now))
    after = cache.join(new.select("cache_key"), "cache_key", "left_anti").unionByName(new, allowMissingColumns=True)
    return wanted.join(after.select("cache_key", "result"), "cache_key", "left"), after


def exists(keys: DataFrame, cache: DataFrame, now: float) -> DataFrame:
    return lookup(keys, cache, now).select("cache_key", F.col("hit").alias("cached"))


def warmed(values: DataFrame, cache: DataFrame, now: float, compute: Callable[[DataFrame], DataFrame] | None = None, enabled: bool = True, ttl: float = TTL) -> tuple[DataFrame, DataFrame]:
    """(cache_key, warm) for each of the values (cache_key, concept), and the cache after it.

    Values that are there are warm.  Others are computed all together and are
    warm where a result came; without a function, or where warming is switched
    off, they are not.
    """
    keys = values.select("cache_key", "concept").dropDuplicates(["cache_key"])
    if not enabled:
        return keys.select("cache_key", F.lit(False).alias("warm")), cache
    found = exists(keys, cache, now)
    if compute is None:
        return found.select("cache_key", F.col("cached").alias("warm")), cache
    new = compute(keys.join(found.where("not cached"), "cache_key", "left_semi")).where("result is not null").withColumns({"expires_at": F.lit(now + ttl), "created_at": F.lit(now)})
    after = cache.join(new.select("cache_key"), "cache_key", "left_anti").unionByName(new, allowMissingColumns=True)
    done = found.join(new.select("cache_key", F.lit(True).alias("made")), "cache_key", "left")
    return done.select("cache_key", (F.col("cached") | F.coalesce("made", F.lit(False))).alias("warm")), after


def to_documents(results: DataFrame, now: float, ttl: float | None = TTL) -> DataFrame:
    """Results (cache_key, result, per_item, overall, plugin, ms) as cache documents: the parts of the key as fields, metadata nested, with defaults."""
    p = parsed_key(F.col("cache_key"))
    meta = F.struct(F.coalesce("plugin", F.lit("unknown")).alias("plugin_name"), F.coalesce("ms", F.lit(0.0)).alias("execution_time_ms"))
    return results.select(
        "cache_key", p["field"].alias("field_name"), p["value"].alias("input_value"), p["context"].alias("media_type"), p["type"].alias("expansion_type"), F.col("result").alias("expansion_result"),
        F.col("per_item").alias("confidence_scores"), F.col("overall").alias("overall_confidence"), meta.alias("source_metadata"), F.lit(True).alias("success"), F.lit(now).alias("created_at"), F.lit(now + ttl if ttl else None).cast("double").alias("expires_at"),
    )


def from_documents(documents: DataFrame) -> DataFrame:
    """Results of cache documents; what a document lacks has its default. Documents whose key hasn't four parts are left out."""
    has = lambda c, default: F.coalesce(F.col(c), default)
    none = F.create_map().cast("map<string,double>")
    return documents.where(parsed_key(F.col("cache_key")).isNotNull()).select("cache_key", F.col("expansion_result").alias("result"), has("confidence_scores", none).alias("per_item"), has("overall_confidence", F.lit(0.0)).alias("overall"), has("source_metadata.plugin_name", F.lit("unknown")).alias("plugin"), has("source_metadata.execution_time_ms", F.lit(0.0)).alias("ms"), has("success", F.lit(True)).alias("success"))


def found_by(documents: DataFrame, field: str | None = None, value: str | None = None, media_type: str | None = None, kind: str | None = None, since: float | None = None, least: float | None = None) -> DataFrame:
    """Secondary look-ups: by field and value, field and media type, type, time and confidence; all that are given must hold."""
    wanted = {"field_name": field, "input_value": value, "media_type": media_type, "expansion_type": kind}
    for c, v in wanted.items():
        if v is not None:
            documents = documents.where(F.col(c) == v)
    if since is not None:
        documents = documents.where(F.col("created_at") >= since)
    return documents if least is None else documents.where(F.col("overall_confidence") >= least)


def write_documents(documents: DataFrame, path: str, files: int) -> None:
    """A folder for each type, in it files in order of field and value, so that look-ups read few row groups."""
    documents.repartitionByRange(files, "expansion_type", "field_name", "input_value").sortWithinPartitions("expansion_type", "field_name", "input_value").write.partitionBy("expansion_type").parquet(path)


def newest(cache: DataFrame, n: int = 10) -> DataFrame:
    return cache.orderBy(F.col("created_at").desc(), "cache_key").limit(n)


def stats(cache: DataFrame, now: float) -> DataFrame:
    return cache.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_if(F.col("created_at") >= now - 86400).alias("last_day"))


def summary(cache: DataFrame) -> DataFrame:
    return cache.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(F.size("result")), 2).alias("concepts"))


def page(cache: DataFrame, skip: int, limit: int) -> DataFrame:
    return cache.orderBy(F.col("created_at").desc(), "cache_key").offset(skip).limit(limit)


def _gone(now: float | None, pattern: str | None, kind: str | None, prefix: str | None) -> Column:
    """Whether an entry goes: it has expired, or is of a pattern, kind or key prefix."""
    gone = F.lit(False)
    if now is not None:
        gone = gone | F.coalesce((F.col("expires_at") != 0) & (F.col("expires_at") < now), F.lit(False))
    if pattern is not None:
        gone = gone | F.col("cache_key").rlike("(?i)" + pattern)
    if kind is not None:
        gone = gone | (F.col("type") == kind)
    if prefix is not None:
        gone = gone | F.startswith("cache_key", F.lit(prefix))
    return F.coalesce(gone, F.lit(False))


def purged(cache: DataFrame, now: float | None = None, pattern: str | None = None, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    """What stays when expired entries, those of a pattern, kind or key prefix go."""
    return cache.where(~_gone(now, pattern, kind, prefix))


def purge_counts(cache: DataFrame, now: float | None = None, pattern: str | None = None, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    """How many entries go in such a purge and how many stay, and how many have expired of those that go."""
    gone, expired = _gone(now, pattern, kind, prefix), _gone(now, None, None, None)
    return cache.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"), F.count_if(gone & expired).alias("expired"))


def hit_rate(found: DataFrame) -> DataFrame:
    n = F.count("*")
    return found.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.when(n > 0, F.count_if("hit") / n).otherwise(0.0), 6).alias("rate"))


def entries(spark, sf) -> DataFrame:
    """Cache entries that stand in the event log: the newest of each key."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select("event_id", F.col("event_type").alias("type"), T.cache_key(F.col("event_type"), F.lit("props"), k.cast("string"), F.concat(F.lit("User "), (F.col("user_id") % 7).cast("string"))).alias("cache_key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("created_at"), F.round(F.col("value") / 1000, 6).alias("confidence"), F.sequence(F.lit(0), F.pmod(k, F.lit(5))).alias("result"))
    newest = rows.groupBy("cache_key").agg(F.max_by(F.struct("type", "created_at", "confidence", "result", "event_id"), F.struct("created_at", "event_id")).alias("x")).select("cache_key", "x.*")
    return newest.withColumn("expires_at", F.when(F.col("event_id") % 4 == 0, 0.0).when(F.col("event_id") % 4 > 1, F.col("created_at") + 86400.0))


NOW = 1706000000.0


def _requests(s, d):
    u = table(s, d, "events").select(F.col("event_type"), (F.col("event_id") % 60).cast("string").alias("v"), (F.col("user_id") % 9).cast("string").alias("u"))
    return u.select(T.cache_key(F.col("event_type"), F.lit("props"), F.col("v"), F.concat(F.lit("user "), F.col("u"))).alias("cache_key"), F.col("v").alias("concept")).distinct()


def _computed(missing: DataFrame) -> DataFrame:
    return missing.select("cache_key", F.element_at(F.split("cache_key", ":"), 1).alias("type"), F.array(F.length("concept")).alias("result"))


def _documents(s, d) -> DataFrame:
    e = entries(s, d)
    items = F.map_from_arrays(F.transform("result", lambda x: x.cast("string")), F.transform("result", lambda x: F.round(1 / (x + 1), 6)))
    return to_documents(e.select("cache_key", "result", F.when(F.size("result") > 1, items).alias("per_item"), F.when(F.col("confidence") > 0.01, F.col("confidence")).alias("overall"), F.when(F.col("type") != "view", F.col("type")).alias("plugin"), F.when(F.col("event_id") % 2 == 0, F.col("confidence") * 1000).alias("ms")), NOW)


E = f"""(SELECT *, CASE WHEN event_id % 4 = 0 THEN 0.0 WHEN event_id % 4 > 1 THEN created_at + 86400.0 END AS expires_at FROM (
 SELECT event_id, event_type AS type, event_type || ':props:' || k || ':user_' || (user_id % 7) AS cache_key, floor(epoch(ts))::DOUBLE AS created_at, round(value / 1000, 6) AS confidence, range(0, k % 5 + 1) AS result
 FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)) QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, event_id DESC) = 1)"""
LIVE = f"(SELECT * FROM {E} WHERE expires_at IS NULL OR expires_at = 0 OR expires_at >= {NOW})"
R = "(SELECT DISTINCT event_type || ':props:' || (event_id % 60) || ':user_' || (user_id % 9) AS cache_key, (event_id % 60)::VARCHAR AS concept FROM events)"

QUERIES = {
    "j1_cache_keys": lambda s, d: table(s, d, "part").select("p_partkey", T.cache_key(F.lit("graph"), F.col("p_name"), F.concat("p_type", F.lit(" & "), "p_brand"), F.lit("recent:Movie")).alias("cache_key")),
    "j1_parsed_keys": lambda s, d: entries(s, d).select(parsed_key(F.col("cache_key")).alias("p")).groupBy("p.type", "p.context").agg(F.count("*").alias("n")),
    "j2_refresh": lambda s, d: get_or_compute(_requests(s, d), entries(s, d), _computed, NOW)[0].select("cache_key", F.size("result").cast("long").alias("n")),
    "j2_cache_only": lambda s, d: get_or_compute(_requests(s, d), entries(s, d), _computed, NOW, "CACHE_ONLY")[0].select("cache_key", F.size("result").cast("long").alias("n")),
    "j3_cache_after": lambda s, d: get_or_compute(_requests(s, d), entries(s, d), _computed, NOW)[1].select("cache_key", "type", "expires_at"),
    "j4_live": lambda s, d: live(entries(s, d), NOW).select("cache_key", "created_at"),
    "j5_exists": lambda s, d: exists(_requests(s, d).select("cache_key"), entries(s, d), NOW),
    "j6_warm": lambda s, d: warmed(_requests(s, d), entries(s, d), NOW, lambda m: _computed(m).where(F.length(F.element_at(F.split("cache_key", ":"), 3)) > 1))[0],
    "j6_warm_without_function": lambda s, d: warmed(_requests(s, d), entries(s, d), NOW)[0],
    "j8_newest": lambda s, d: newest(entries(s, d)).select("cache_key", "created_at"),
    "j12_documents": lambda s, d: _documents(s, d).select("cache_key", "field_name", "input_value", "media_type", "expansion_type", "overall_confidence", F.col("source_metadata.plugin_name").alias("plugin"), "expires_at"),
    "j12_results": lambda s, d: from_documents(_documents(s, d)).select("cache_key", F.size("result").cast("long").alias("n"), F.round(F.aggregate(F.map_values("per_item"), F.lit(0.0), lambda a, x: a + x), 5).alias("sum"), "overall", "plugin", F.round("ms", 4).alias("ms")),
    "j13_lookups": lambda s, d: found_by(_documents(s, d), field="props", media_type="user_3", least=0.01).select("cache_key", "overall_confidence"),
    "j7_stats": lambda s, d: stats(entries(s, d), NOW),
    "j8_summary": lambda s, d: summary(entries(s, d)),
    "j9_page": lambda s, d: page(entries(s, d), 20, 30).select("cache_key", "created_at"),
    "j10_purge_counts": lambda s, d: purge_counts(entries(s, d), NOW, "user_3$", "view"),
    "j10_purge": lambda s, d: purged(entries(s, d), NOW, "user_3$", "view").select("cache_key"),
    "j11_hit_rate": lambda s, d: hit_rate(lookup(_requests(s, d), entries(s, d), NOW)),
}
ORACLES = {
    "j1_cache_keys": f"SELECT p_partkey, 'graph:' || {key_sql('p_name')} || ':' || {key_sql(chr(39).join(['p_type || ', ' & ', ' || p_brand']))} || ':recentmovie' AS cache_key FROM part",
    "j1_parsed_keys": f"SELECT split_part(cache_key, ':', 1) AS type, split_part(cache_key, ':', 4) AS context, count(*) AS n FROM {E} GROUP BY 1, 2",
    "j2_refresh": f"SELECT r.cache_key, coalesce(len(result), 1)::BIGINT AS n FROM {R} r LEFT JOIN {LIVE} c USING (cache_key)",
    "j2_cache_only": f"SELECT cache_key, len(result)::BIGINT AS n FROM {R} JOIN {LIVE} USING (cache_key)",
    "j3_cache_after": f"SELECT cache_key, type, expires_at FROM {E} WHERE cache_key IN (SELECT cache_key FROM {LIVE}) OR cache_key NOT IN (SELECT cache_key FROM {R}) UNION ALL SELECT cache_key, split_part(cache_key, ':', 1), {NOW + TTL} FROM {R} WHERE cache_key NOT IN (SELECT cache_key FROM {LIVE})",
    "j4_live": f"SELECT cache_key, created_at FROM {LIVE}",
    "j5_exists": f"SELECT cache_key, cache_key IN (SELECT cache_key FROM {LIVE}) AS cached FROM {R}",
    "j6_warm": f"SELECT cache_key, cache_key IN (SELECT cache_key FROM {LIVE}) OR length(concept) > 1 AS warm FROM {R}",
    "j6_warm_without_function": f"SELECT cache_key, cache_key IN (SELECT cache_key FROM {LIVE}) AS warm FROM {R}",
    "j8_newest": f"SELECT cache_key, created_at FROM {E} ORDER BY created_at DESC, cache_key LIMIT 10",
    "j12_documents": f"SELECT cache_key, split_part(cache_key, ':', 2) AS field_name, split_part(cache_key, ':', 3) AS input_value, split_part(cache_key, ':', 4) AS media_type, type AS expansion_type, CASE WHEN confidence > 0.01 THEN confidence END AS overall_confidence, CASE WHEN type <> 'view' THEN type ELSE 'unknown' END AS plugin, {NOW + TTL}::DOUBLE AS expires_at FROM {E}",
    "j12_results": f"SELECT cache_key, len(result)::BIGINT AS n, round(CASE WHEN len(result) > 1 THEN list_sum(list_transform(result, lambda x: round(1 / (x + 1), 6))) ELSE 0.0 END, 5) AS sum, CASE WHEN confidence > 0.01 THEN confidence ELSE 0.0 END AS overall, CASE WHEN type <> 'view' THEN type ELSE 'unknown' END AS plugin, round(CASE WHEN event_id % 2 = 0 THEN confidence * 1000 ELSE 0.0 END, 4) AS ms FROM {E}",
    "j13_lookups": f"SELECT cache_key, confidence AS overall_confidence FROM {E} WHERE split_part(cache_key, ':', 2) = 'props' AND split_part(cache_key, ':', 4) = 'user_3' AND confidence > 0.01 AND confidence >= 0.01",
    "j7_stats": f"SELECT type, count(*) AS n, round(avg(confidence), 6) AS confidence, count(*) FILTER (created_at >= {NOW} - 86400) AS last_day FROM {E} GROUP BY 1",
    "j8_summary": f"SELECT type, count(*) AS n, round(avg(len(result)), 2) AS concepts FROM {E} GROUP BY 1",
    "j9_page": f"SELECT cache_key, created_at FROM {E} ORDER BY created_at DESC, cache_key LIMIT 30 OFFSET 20",
    "j10_purge_counts": f"SELECT count(*) FILTER (g) AS deleted, count(*) FILTER (NOT g) AS kept, count(*) FILTER (x) AS expired FROM (SELECT x, x OR regexp_matches(cache_key, 'user_3$') OR type = 'view' AS g FROM (SELECT *, coalesce(expires_at <> 0 AND expires_at < {NOW}, false) AS x FROM {E}))",
    "j10_purge": f"SELECT cache_key FROM {E} WHERE NOT (coalesce(expires_at <> 0 AND expires_at < {NOW}, false) OR regexp_matches(cache_key, 'user_3$') OR type = 'view')",
    "j11_hit_rate": f"SELECT count(*) FILTER (h) AS hits, count(*) FILTER (NOT h) AS misses, round(count(*) FILTER (h) / count(*), 6) AS rate FROM (SELECT cache_key IN (SELECT cache_key FROM {LIVE}) AS h FROM {R})",
}
