import random
from datetime import datetime, timedelta

import pytest
from tesserine.operators import telemetry as t


def replayed(rows, rolling, slow):
    """Health of each check by hand, service by service."""
    out = {}
    for service in {r[0] for r in rows}:
        seen, failures, healthy = [], 0, None
        for _, ts, i, ok, ms, _ in sorted((r for r in rows if r[0] == service), key=lambda r: (r[1], r[2])):
            seen.append(ms)
            failures, healthy = (0, ts) if ok else (failures + 1, healthy)
            last = seen[-rolling:]
            out[i] = (round(sum(last) / len(last), 6), "UNHEALTHY" if not ok else "HEALTHY" if ms < slow else "DEGRADED", failures, healthy)
    return out


def checks(spark):
    """Two thirds of all checks are of one service, in bursts and with long gaps."""
    r, at, rows = random.Random(3), datetime(2024, 1, 1), []
    for i in range(4000):
        at += timedelta(seconds=r.choice((0, 0.5, 1, 20, 4000)))
        rows.append((r.choice((1, 1, 1, 1, 2, None)), at, i, r.random() < (0.02 if 1000 < i < 2500 else 0.7), float(r.randint(1, 3000)), r.choice(("view", "click"))))
    return rows, spark.createDataFrame(rows, "service long, ts timestamp, id long, ok boolean, ms double, event_type string").repartition(5)


@pytest.mark.parametrize("slice_s,chunk", [(3600, 10_000), (60, 50), (100_000_000, 25), (1, 20)])
def test_health_passes_over_chunks(spark, monkeypatch, slice_s, chunk):
    rows, c = checks(spark)
    monkeypatch.setattr(t, "SLICE_S", slice_s)
    monkeypatch.setattr(t, "CHUNK", chunk)
    got = {r.id: (round(r.rolling_ms, 6), r.status, r.failures, r.last_healthy) for r in t.health(c).collect()}
    assert got == replayed(rows, 20, 1000.0)


def test_a_hot_service_is_in_many_chunks_and_gauges_see_one_check_back(spark, monkeypatch):
    rows, c = checks(spark)
    whole = sorted(map(tuple, t.gauges(c).collect()), key=str)
    monkeypatch.setattr(t, "CHUNK", 64)
    chunks = t.chunked(c, 1).where("own and service = 1")
    assert chunks.groupBy("chunk").count().where("count > 64").count() == 0 and chunks.select("chunk").distinct().count() > 30
    assert sorted(map(tuple, t.gauges(c).collect()), key=str) == whole
    increase = 0.0
    own = [r[4] for r in sorted((r for r in rows if r[0] == 2), key=lambda r: (r[1], r[2]))]
    for a, b in zip(own, own[1:]):
        increase += b - a if b >= a else b
    assert {r.service: r.increase for r in t.gauges(c).collect()}[2] == round(increase, 4)
    assert t.health(c.limit(0)).collect() == []
