"""Service telemetry over event logs: rolling health, alerts, rates, latencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import table


def checks(events: DataFrame, failure: str = "error") -> DataFrame:
    """Health checks: service, ts, id, ok, ms."""
    return events.select(F.col("user_id").alias("service"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), (F.col("event_type") != failure).alias("ok"), F.col("value").alias("ms"), "event_type")


#: Seconds of a slice in which checks are numbered, and checks of a chunk in which they are taken one after another.
SLICE_S, CHUNK = 3600, 10_000


def chunked(c: DataFrame, before: int, slice_s: int | None = None, chunk: int | None = None) -> DataFrame:
    """c with pos (place of a check among those of its service), chunk, and own: whole chunks of a service, and before each the last `before` checks of the one before it (own is false).

    Checks are numbered within slices of time, and a row for each slice tells how
    many come before it; so a service with very many checks is in many tasks.
    """
    slice_s, chunk = slice_s or SLICE_S, chunk or CHUNK
    order = [F.col("ts").asc_nulls_first(), F.col("id").asc_nulls_first()]
    rows = c.withColumn("slice", F.floor(F.unix_micros("ts") / (slice_s * 1_000_000)))
    sizes = rows.groupBy("service", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("service").orderBy(F.col("slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("service").alias("s"), F.col("slice").alias("t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("service", "slice").orderBy(*order)))
    placed = numbered.join(offsets, F.col("service").eqNullSafe(F.col("s")) & F.col("slice").eqNullSafe(F.col("t"))).withColumn("pos", F.col("offset") + F.col("nth") - 1)
    home = F.floor(F.col("pos") / chunk)
    copies = F.when(F.col("pos") % chunk >= chunk - before, F.array(home, home + 1)).otherwise(F.array(home))
    return placed.withColumn("home", home).withColumn("chunk", F.explode(copies)).withColumn("own", F.col("chunk") == F.col("home")).drop("slice", "nth", "s", "t", "offset", "home")


def health(c: DataFrame, rolling: int = 20, slow: float = 1000.0) -> DataFrame:
    """Rolling mean, status, failures in a row and last healthy time at each check.

    A chunk's rows see the last checks before it; failures and the last healthy
    check pass from chunk to chunk in a row for each.
    """
    status = F.when(~F.col("ok"), "UNHEALTHY").when(F.col("ms") < slow, "HEALTHY").otherwise("DEGRADED")
    by = Window.partitionBy("service", "chunk").orderBy("pos")
    own = lambda x: F.when(F.col("own"), x)
    rows = chunked(c, rolling - 1).withColumns({"rolling_ms": F.avg("ms").over(by.rowsBetween(1 - rolling, 0)), "failed": F.coalesce(F.sum(own((~F.col("ok")).cast("long"))).over(by), F.lit(0))})
    rows = rows.withColumns({"since": F.last(own(F.when(F.col("ok"), F.col("failed"))), True).over(by), "healthy": F.last(own(F.when(F.col("ok"), F.col("ts"))), True).over(by)}).where("own")

    last = F.struct("pos", "since", "healthy", "failed")
    ends = rows.groupBy("service", "chunk").agg(F.max(last).alias("x")).select("service", "chunk", "x.*")
    chunks = Window.partitionBy("service").orderBy("chunk")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base", F.coalesce(F.sum("failed").over(earlier), F.lit(0)))
    carried = ends.select(F.col("service").alias("s"), F.col("chunk").alias("t"), "base", F.last(F.col("base") + F.col("since"), True).over(earlier).alias("since_before"), F.last("healthy", True).over(earlier).alias("healthy_before"))
    out = rows.join(carried, F.col("service").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("t")))
    failures = F.col("base") + F.col("failed") - F.coalesce(F.col("base") + F.col("since"), F.col("since_before"), F.lit(0))
    return out.select(*c.columns, "rolling_ms", status.alias("status"), failures.alias("failures"), F.coalesce("healthy", "healthy_before").alias("last_healthy"))


def alerts(h: DataFrame, failures: int = 3, slow: float = 2000.0) -> DataFrame:
    kind = F.when(F.col("failures") >= failures, "UNHEALTHY").when(F.col("rolling_ms") > slow, "DEGRADED")
    return h.withColumn("alert", kind).where("alert is not null")


def uptime(c: DataFrame, since=None) -> DataFrame:
    c = c.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else c
    return c.groupBy("service").agg(F.count("*").alias("checks"), F.round(F.avg(F.col("ok").cast("int")) * 100, 4).alias("uptime"))


def service_summary(h: DataFrame) -> DataFrame:
    """Services by their latest status, with one overall verdict."""
    last = h.groupBy("service").agg(F.max_by("status", F.struct("ts", "id")).alias("status"))
    out = last.agg(F.count("*").alias("services"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("HEALTHY", "DEGRADED", "UNHEALTHY")))
    return out.withColumn("overall", F.when(F.col("unhealthy") > 0, "unhealthy").when(F.col("degraded") > 0, "degraded").when(F.col("healthy") > 0, "healthy").otherwise("unknown"))


def health_score(h: DataFrame) -> DataFrame:
    s = service_summary(h).withColumn("score", F.round(F.col("healthy") / F.col("services"), 6))
    return s.select("score", F.when(F.col("score") >= 0.8, "healthy").when(F.col("score") >= 0.5, "degraded").otherwise("critical").alias("verdict"))


def last_errors(c: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("service").orderBy(F.col("ts").desc(), F.col("id").desc())
    return c.where("not ok").withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).groupBy("service").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"].cast("string")), ",").alias("errors"))


def recommendations(h: DataFrame) -> DataFrame:
    last = h.groupBy("service").agg(F.max_by("failures", F.struct("ts", "id")).alias("failures"))
    return last.select("service", "failures", F.when(F.col("failures") >= 5, "high/restart").when(F.col("failures") >= 3, "medium/check").otherwise("low/monitor").alias("advice"))


def counters(c: DataFrame, key: str = "event_type") -> DataFrame:
    return c.groupBy(key).agg(F.count("*").alias("executions"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.sum("ms"), 4).alias("total_ms"), F.round(F.avg("ms"), 4).alias("mean_ms"))


def request_metrics(c: DataFrame) -> DataFrame:
    return c.agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("success_rate"), F.round(F.avg("ms"), 4).alias("mean_ms"))


def breaker(c: DataFrame, failures: int = 5, idle_s: int = 60, slice_s: int = 3600) -> DataFrame:
    """Circuit state after each check: failures in a row open it, the next check after an idle minute half-opens it, a success closes it.

    With the number of a failure in its run, the run is open from number
    `failures` on, and half-open once an idle gap lies before a later one.
    Checks are taken in slices of time of a service, so that a service with very
    many is in many tasks; a row for each slice carries the run at its end (its
    length, the number after its last idle gap and its time) to the next one.
    """
    order = [F.col("ts").asc_nulls_last(), F.col("id").asc_nulls_last()]
    ok, us = F.coalesce("ok", F.lit(False)), F.unix_micros("ts")
    idle = lambda since: F.coalesce(us - since >= idle_s * 1_000_000, F.lit(False))
    piece = Window.partitionBy("service", "slice").orderBy(*order)
    run = Window.partitionBy("service", "slice", "island").orderBy(*order)
    rows = c.select("service", "ts", "id", ok.alias("ok"), F.floor(us / (slice_s * 1_000_000)).alias("slice"))
    rows = rows.withColumn("island", F.sum(F.col("ok").cast("int")).over(piece))
    # A run within a slice: an island's failures follow its success, if it has one.
    rows = rows.withColumns({"number": F.sum((~F.col("ok")).cast("int")).over(run), "since": F.lag(F.when(~F.col("ok"), us)).over(run)})
    rows = rows.withColumn("gap", F.max(F.when(~F.col("ok") & idle(F.col("since")), F.col("number"))).over(run))

    last = F.struct("island", "number", F.coalesce("gap", F.lit(0)).alias("gap"))
    ends = rows.groupBy("service", "slice").agg(F.max(last).alias("x"), F.min(us).alias("first"), F.max(us).alias("last"))
    ends = ends.select("service", "slice", F.col("x.island").alias("successes"), F.col("x.number").alias("tail"), F.nullif("x.gap", F.lit(0)).alias("tail_gap"), "first", "last")
    slices = Window.partitionBy("service").orderBy(F.col("slice").asc_nulls_last())
    ends = ends.withColumns({"stretch": F.sum((F.col("successes") > 0).cast("int")).over(slices), "before": F.lag("last").over(slices)})
    stretch = Window.partitionBy("service", "stretch").orderBy(F.col("slice").asc_nulls_last())
    ends = ends.withColumn("length", F.sum("tail").over(stretch)).withColumn("start", F.col("length") - F.col("tail"))
    crossed = (F.col("successes") == 0) & (F.col("start") > 0) & F.coalesce(F.col("first") - F.col("before") >= idle_s * 1_000_000, F.lit(False))
    ends = ends.withColumn("end_gap", F.max(F.col("start") + F.coalesce("tail_gap", F.when(crossed, 1))).over(stretch))
    carried = ends.select(F.col("service").alias("s"), F.col("slice").alias("t"), "first", "before", F.coalesce(F.lag("length").over(slices), F.lit(0)).alias("run_before"), F.lag("end_gap").over(slices).alias("gap_before"))

    joined = rows.join(carried, F.col("service").eqNullSafe(F.col("s")) & F.col("slice").eqNullSafe(F.col("t")))
    goes_on = (F.col("island") == 0) & (F.col("run_before") > 0)
    number = F.col("number") + F.when(goes_on, F.col("run_before")).otherwise(0)
    first_gap = F.col("first") - F.col("before") >= idle_s * 1_000_000
    gap = F.greatest(number - F.col("number") + F.col("gap"), F.when(goes_on, F.col("gap_before")), F.when(goes_on & first_gap, F.col("run_before") + 1))
    state = F.when(F.col("ok") | (number < failures), "CLOSED").when(F.coalesce(gap > max(failures, 1), F.lit(False)), "HALF_OPEN").otherwise("OPEN")
    return joined.select("service", "id", state.alias("state"))


#: Quantiles of a window, and parts that the span of its values is cut into to find them.
QUANTILES, PARTS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, 256
#: Size parameter of the quantile sketches: the rank of a value is right to about 1.65 / SKETCH of the window's values with 99 % confidence.
SKETCH = 800


def seconds(length: str) -> float:
    """Seconds of a length such as "5 minutes"."""
    n, unit = length.split()
    return float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def _opened(c: DataFrame, length: str, slide: str | None) -> DataFrame:
    return c.withColumn("w", F.window("ts", length, slide) if slide else F.window("ts", length))


def _rates(rows: DataFrame, length: str, keys: tuple[str, ...]) -> DataFrame:
    return rows.select(F.unix_timestamp("w.start").alias("start"), *keys, "n", "errors", F.round(F.col("n") / seconds(length), 6).alias("rate"), F.round(F.col("errors") / F.col("n"), 6).alias("error_rate"), *(F.round(p, 4).alias(p) for p in QUANTILES))


def quantiles(rows: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """keys, and the exact quantiles of each group: the smallest value that so large a share of the group's values doesn't exceed.

    The span between a group's least and largest value is cut into PARTS parts.
    Counts of the parts, summed before they are shuffled, tell in which a
    quantile lies; only the values of these parts, each once with its count, are
    put in order.  Nulls don't count; a group without a value has no row.
    """
    some = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    span = some.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("k").alias("all"))
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))
    width = (F.col("high") - F.col("low")) / PARTS
    part = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(PARTS - 1))).otherwise(0)
    dealt = some.alias("a").join(span.alias("b"), same("a", "b")).select(*(F.col(f"a.{k}") for k in keys), "v", "k", "all", part.cast("int").alias("part"))
    parts = dealt.groupBy(*keys, "part").agg(F.sum("k").alias("in_part"), F.first("all").alias("all"))
    upto = F.sum("in_part").over(Window.partitionBy(*keys).orderBy("part"))  # PARTS rows a group
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.ceil(F.lit(q) * F.col("all")).alias("rank")) for name, q in QUANTILES.items())))
    wanted = parts.withColumn("upto", upto).select(*keys, "part", "upto", "in_part", asked.alias("q")).where((F.col("q.rank") <= F.col("upto")) & (F.col("q.rank") > F.col("upto") - F.col("in_part")))
    hit = wanted.groupBy(*keys, "part").agg(F.first(F.col("upto") - F.col("in_part")).alias("before"), F.collect_list("q").alias("qs"))
    close = dealt.alias("a").join(hit.alias("b"), same("a", "b") & (F.col("a.part") == F.col("b.part"))).select(*(F.col(f"a.{k}") for k in keys), F.col("a.part").alias("part"), "v", "k", "before", "qs")
    reached = F.col("before") + F.sum("k").over(Window.partitionBy(*keys, "part").orderBy("v"))
    placed = close.withColumn("reached", reached).select(*keys, "v", F.explode(F.filter("qs", lambda q: (q["rank"] <= F.col("reached")) & (q["rank"] > F.col("reached") - F.col("k")))).alias("q"))
    return placed.groupBy(*keys).agg(*(F.max(F.when(F.col("q.name") == n, F.col("v"))).alias(n) for n in QUANTILES))


def windowed(c: DataFrame, length: str = "5 minutes", slide: str | None = None, *keys: str) -> DataFrame:
    """Requests, errors, rate a second and exact latency quantiles by event-time window, at every size of window."""
    rows = _opened(c, length, slide)
    counts = rows.groupBy("w", *keys).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"))
    found = quantiles(rows, ["w", *keys]).withColumnsRenamed({k: f"__{k}" for k in ("w", *keys)})
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in ("w", *keys)))
    return _rates(counts.join(found, on, "left"), length, keys)


def sketched(c: DataFrame, length: str = "5 minutes", slide: str | None = None, *keys: str, pane: str = "1 minute") -> DataFrame:
    """The same with quantiles of mergeable sketches: a sketch a pane, panes merged into all windows that hold them.

    A quantile's rank is right to about 1.65 / SKETCH with 99 % confidence, at
    every size of window; windows and slides are multiples of the pane.
    """
    panes = c.groupBy(F.window("ts", pane).alias("pane"), *keys).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"), F.kll_sketch_agg_double("ms", F.lit(SKETCH)).alias("sketch"))
    rows = panes.withColumn("w", F.window(F.col("pane.start"), length, slide) if slide else F.window(F.col("pane.start"), length))
    merged = rows.groupBy("w", *keys).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
    return _rates(merged.withColumns({n: F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for n, q in QUANTILES.items()}), length, keys)


def per_minute(c: DataFrame, length: str = "5 minutes", *keys: str) -> DataFrame:
    """Tasks done and failed a minute, by window."""
    minutes = seconds(length) / 60
    rows = c.groupBy(F.window("ts", length).alias("w"), *keys).agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))
    return rows.select(F.unix_timestamp("w.start").alias("start"), *keys, *(F.round(F.col(x) / minutes, 6).alias(x) for x in ("done", "failed")))


def gauges(c: DataFrame) -> DataFrame:
    """Of each series: the latest sample, whether it is up, how many of its tasks are in progress, the sum of its counter's increases (a fall is a reset), and that a second in percent."""
    w = Window.partitionBy("service", "chunk").orderBy("pos")
    step = F.col("ms") - F.lag("ms").over(w)
    at = F.struct("ts", "id")
    rows = chunked(c, 1).withColumn("step", step).where("own")
    step = F.col("step")
    rows = rows.withColumn("up", F.when(step >= 0, step).when(step < 0, F.col("ms")))
    out = rows.groupBy("service").agg(F.round(F.max_by("ms", at), 4).alias("latest"), F.max_by("ok", at).alias("is_up"), F.greatest(F.count_if(F.col("event_type") == "view") - F.count_if(F.col("event_type") == "click"), F.lit(0)).alias("in_progress"), F.round(F.sum("up"), 4).alias("increase"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    span = F.unix_micros("t1") - F.unix_micros("t0")
    return out.withColumn("rate_percent", F.when(span > 0, F.round(F.col("increase") / (span / 1e6) * 100, 4))).drop("t0", "t1")


def routed(tasks: DataFrame, attempts: F.Column, most: int = 3, delay: float = 2.0) -> DataFrame:
    """Failed records: retried with growing delay, or to the dead letters."""
    return tasks.where("not ok").select("id", attempts.alias("attempts"), F.when(attempts < most, "retry").otherwise("dead_letter").alias("route"), F.when(attempts < most, F.pow(F.lit(2.0), attempts) * delay).alias("delay_s"))


def _c(s, d):
    return checks(table(s, d, "events"))




C = "(SELECT user_id AS service, ts, event_id AS id, event_type <> 'error' AS ok, value AS ms, event_type FROM events)"
H = f"""(SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY service, island ORDER BY ts, id)::BIGINT AS failures FROM (SELECT *, avg(ms) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rolling_ms, CASE WHEN NOT ok THEN 'UNHEALTHY' WHEN ms < 100 THEN 'HEALTHY' ELSE 'DEGRADED' END AS status, sum(ok::INT) OVER w AS island, last_value(CASE WHEN ok THEN ts END IGNORE NULLS) OVER w AS last_healthy FROM {C} WINDOW w AS (PARTITION BY service ORDER BY ts, id)))"""
_h = lambda s, d: health(_c(s, d), slow=100.0)
_S = f"(SELECT count(*) AS services, count(*) FILTER (status = 'HEALTHY') AS healthy, count(*) FILTER (status = 'DEGRADED') AS degraded, count(*) FILTER (status = 'UNHEALTHY') AS unhealthy FROM (SELECT service, arg_max(status, {{'t': ts, 'i': id}}) AS status FROM {H} GROUP BY 1))"
_Q = ", ".join(f"round(list_sort(list(ms))[greatest(1, ceil({q}::DOUBLE * count(*)))::INT], 4) AS p{n}" for q, n in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))

QUERIES = {
    "l1_rolling_health": lambda s, d: _h(s, d).select("id", F.round("rolling_ms", 6).alias("rolling_ms"), "status", F.col("failures").cast("long").alias("failures"), F.unix_timestamp("last_healthy").alias("last_healthy")),
    "l4_uptime": lambda s, d: uptime(_c(s, d)),
    "l4_uptime_window": lambda s, d: uptime(_c(s, d), "2024-01-15"),
    "l5_alerts": lambda s, d: alerts(_h(s, d), 2, 60.0).select("id", "service", "alert"),
    "l6_service_summary": lambda s, d: service_summary(_h(s, d)),
    "l7_last_errors": lambda s, d: last_errors(_c(s, d)),
    "l8_health_score": lambda s, d: health_score(_h(s, d)),
    "l9_recommendations": lambda s, d: recommendations(_h(s, d)).withColumn("failures", F.col("failures").cast("long")),
    "l10_counters": lambda s, d: counters(_c(s, d)),
    "l11_request_metrics": lambda s, d: request_metrics(_c(s, d)),
    "l12_breaker": lambda s, d: breaker(_c(s, d), 2, 3600),
    "l13_windows": lambda s, d: windowed(_c(s, d), "5 minutes"),
    "l13_sliding_by_type": lambda s, d: windowed(_c(s, d), "5 minutes", "1 minute", "event_type").select("start", "event_type", "n", "rate"),
    "l13_minute_windows": lambda s, d: windowed(_c(s, d), "1 minutes").select("start", "n", "rate"),
    "l16_tasks_per_minute": lambda s, d: per_minute(_c(s, d), "5 minutes", "event_type"),
    "l17_gauges": lambda s, d: gauges(_c(s, d)),
    "l18_routing": lambda s, d: routed(_c(s, d), (F.col("id") % 5).cast("long")),
}
_WIN = "epoch(time_bucket(INTERVAL 5 MINUTE, ts))::BIGINT"
ORACLES = {
    "l1_rolling_health": f"SELECT id, round(rolling_ms, 6) AS rolling_ms, status, failures, floor(epoch(last_healthy))::BIGINT AS last_healthy FROM {H}",
    "l4_uptime": f"SELECT service, count(*) AS checks, round(avg(ok::INT) * 100, 4) AS uptime FROM {C} GROUP BY 1",
    "l4_uptime_window": f"SELECT service, count(*) AS checks, round(avg(ok::INT) * 100, 4) AS uptime FROM {C} WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1",
    "l5_alerts": f"SELECT id, service, alert FROM (SELECT *, CASE WHEN failures >= 2 THEN 'UNHEALTHY' WHEN rolling_ms > 60 THEN 'DEGRADED' END AS alert FROM {H}) WHERE alert IS NOT NULL",
    "l6_service_summary": f"SELECT *, CASE WHEN unhealthy > 0 THEN 'unhealthy' WHEN degraded > 0 THEN 'degraded' WHEN healthy > 0 THEN 'healthy' ELSE 'unknown' END AS overall FROM {_S}",
    "l7_last_errors": f"SELECT service, string_agg(id::VARCHAR, ',' ORDER BY n) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC, id DESC) AS n FROM {C} WHERE NOT ok) WHERE n <= 3 GROUP BY 1",
    "l8_health_score": f"SELECT score, CASE WHEN score >= 0.8 THEN 'healthy' WHEN score >= 0.5 THEN 'degraded' ELSE 'critical' END AS verdict FROM (SELECT round(healthy / services, 6) AS score FROM {_S})",
    "l9_recommendations": f"SELECT service, failures, CASE WHEN failures >= 5 THEN 'high/restart' WHEN failures >= 3 THEN 'medium/check' ELSE 'low/monitor' END AS advice FROM (SELECT service, arg_max(failures, {{'t': ts, 'i': id}}) AS failures FROM {H} GROUP BY 1)",
    "l10_counters": f"SELECT event_type, count(*) AS executions, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, round(sum(ms), 4) AS total_ms, round(avg(ms), 4) AS mean_ms FROM {C} GROUP BY 1",
    "l11_request_metrics": f"SELECT count(*) AS total, count(*) FILTER (NOT ok) AS failed, round(avg(ok::INT), 6) AS success_rate, round(avg(ms), 4) AS mean_ms FROM {C}",
    "l12_breaker": f"SELECT service, id, CASE WHEN ok OR number < 2 THEN 'CLOSED' WHEN gap > 2 THEN 'HALF_OPEN' ELSE 'OPEN' END AS state FROM (SELECT *, max(CASE WHEN NOT ok AND ts - before >= INTERVAL 3600 SECOND THEN number END) OVER r AS gap FROM (SELECT *, sum((NOT ok)::INT) OVER r AS number, lag(CASE WHEN NOT ok THEN ts END) OVER r AS before FROM (SELECT *, sum(ok::INT) OVER (PARTITION BY service ORDER BY ts, id) AS island FROM {C}) WINDOW r AS (PARTITION BY service, island ORDER BY ts, id)) WINDOW r AS (PARTITION BY service, island ORDER BY ts, id))",
    "l13_windows": f"SELECT {_WIN} AS start, count(*) AS n, count(*) FILTER (NOT ok) AS errors, round(count(*) / 300.0, 6) AS rate, round(count(*) FILTER (NOT ok) / count(*), 6) AS error_rate, {_Q} FROM {C} GROUP BY 1",
    "l13_sliding_by_type": f"SELECT start, event_type, count(*) AS n, round(count(*) / 300.0, 6) AS rate FROM (SELECT event_type, epoch(time_bucket(INTERVAL 1 MINUTE, ts))::BIGINT - 60 * k AS start FROM {C}, range(5) r(k)) GROUP BY 1, 2",
    "l13_minute_windows": f"SELECT epoch(time_bucket(INTERVAL 1 MINUTE, ts))::BIGINT AS start, count(*) AS n, round(count(*) / 60.0, 6) AS rate FROM {C} GROUP BY 1",
    "l16_tasks_per_minute": f"SELECT {_WIN} AS start, event_type, round(count(*) FILTER (ok) / 5.0, 6) AS done, round(count(*) FILTER (NOT ok) / 5.0, 6) AS failed FROM {C} GROUP BY 1, 2",
    "l17_gauges": f"SELECT service, latest, is_up, in_progress, increase, CASE WHEN span > 0 THEN round(increase / (span / 1e6) * 100, 4) END AS rate_percent FROM (SELECT service, round(arg_max(ms, {{'t': ts, 'i': id}}), 4) AS latest, arg_max(ok, {{'t': ts, 'i': id}}) AS is_up, greatest(count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'click'), 0) AS in_progress, round(sum(CASE WHEN ms - b >= 0 THEN ms - b WHEN ms - b < 0 THEN ms END), 4) AS increase, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM (SELECT *, lag(ms) OVER (PARTITION BY service ORDER BY ts, id) AS b FROM {C}) GROUP BY 1)",
    "l18_routing": f"SELECT id, id % 5 AS attempts, CASE WHEN id % 5 < 3 THEN 'retry' ELSE 'dead_letter' END AS route, CASE WHEN id % 5 < 3 THEN pow(2.0, id % 5) * 2.0 END AS delay_s FROM {C} WHERE NOT ok",
}
