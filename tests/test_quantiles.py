import math
import random
from datetime import datetime, timedelta

from tesserine.operators import telemetry as t


def checks(spark, n, seed=1):
    r, at = random.Random(seed), datetime(2024, 1, 1)
    rows = [(i, at + timedelta(seconds=r.random() * 600), r.choice([None, "view"]), r.random() < 0.9, r.choice([r.random() * 1000, float(r.randint(0, 5)), 1e6, None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, ts timestamp, event_type string, ok boolean, ms double")


def exact(values):
    v = sorted(x for x in values if x is not None)
    return {n: round(v[math.ceil(q * len(v)) - 1], 4) if v else None for n, q in t.QUANTILES.items()}


def windows(rows, length, slide):
    out = {}
    for _, ts, kind, ok, ms in rows:
        s = (ts - datetime(1970, 1, 1)).total_seconds()
        start = math.floor(s / slide) * slide
        while start > s - length:
            out.setdefault((start, kind), []).append(ms)
            start -= slide
    return out


def test_exact_at_every_size(spark):
    rows, c = checks(spark, 40_000)  # windows of over 10,000 values
    want = windows(rows, 300, 60)
    got = {(r.start, r.event_type): r for r in t.windowed(c, "5 minutes", "1 minute", "event_type").collect()}
    assert got.keys() == want.keys() and max(map(len, want.values())) > 9_000
    for k, values in want.items():
        assert got[k].n == len(values) and {n: got[k][n] for n in t.QUANTILES} == exact(values)


def test_sketches_keep_their_bound(spark):
    rows, c = checks(spark, 40_000, 2)
    want = windows(rows, 300, 60)
    seen = t.sketched(c, "5 minutes", "1 minute", "event_type").collect()
    assert {(r.start, r.event_type): r.n for r in seen} == {k: len(v) for k, v in want.items()}
    off = []
    for r in seen:
        v = sorted(x for x in want[r.start, r.event_type] if x is not None)
        for n, q in t.QUANTILES.items():
            low, high = sum(x < r[n] - 1e-3 for x in v), sum(x <= r[n] + 1e-3 for x in v)
            off.append(max(0.0, low - q * len(v), q * len(v) - high) / len(v))
    assert max(off) <= 3 * 1.65 / t.SKETCH and sum(x > 1.65 / t.SKETCH for x in off) <= 0.05 * len(off)


def test_few_null_and_equal_values(spark):
    at = datetime(2024, 1, 1)
    c = spark.createDataFrame([(1, at, "a", True, None), (2, at, "b", True, 5.0), (3, at, "b", False, 5.0), (4, at, "c", True, 1.0), (5, at, "c", True, 2.0)], "id long, ts timestamp, event_type string, ok boolean, ms double")
    got = {r.event_type: (r.n, r.errors, r.p50, r.p99) for r in t.windowed(c, "5 minutes", None, "event_type").collect()}
    assert got == {"a": (1, 0, None, None), "b": (2, 1, 5.0, 5.0), "c": (2, 0, 1.0, 2.0)}
    assert t.windowed(c.limit(0)).collect() == [] == t.sketched(c.limit(0)).collect()
