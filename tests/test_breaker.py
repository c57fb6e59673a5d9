import random
from datetime import datetime, timedelta

import pytest
from tesserine.operators.telemetry import breaker

SCHEMA = "service long, ts timestamp, id long, ok boolean"


def replayed(rows, failures, idle_s):
    state, out = {}, {}
    for service, ts, i, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        now, run, last = state.get(service, ("CLOSED", 0, None))
        if now == "OPEN" and (ts - last).total_seconds() >= idle_s:
            now = "HALF_OPEN"
        if ok:
            now, run = "CLOSED", 0
        else:
            run, last = run + 1, ts
            if now == "CLOSED" and run >= failures:
                now = "OPEN"
        state[service] = (now, run, last)
        out[i] = now
    return out


@pytest.mark.parametrize("slice_s", [1, 30, 10_000_000])
def test_runs_pass_over_slices(spark, slice_s):
    r = random.Random(5)
    rows, at = [], datetime(2024, 1, 1)
    for i in range(3000):
        at += timedelta(seconds=r.choice((0, 0.5, 1, 5, 9.999999, 10, 40)))
        rows.append((r.choice((1, 1, 1, 2, 3, None)), at, i, r.random() < 0.15))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for failures in (1, 2, 5):
        got = {x.id: x.state for x in breaker(df, failures, 10, slice_s).collect()}
        want = replayed(rows, failures, 10)
        assert len(set(want.values())) == 3
        assert got == want


def test_no_service_is_gathered_in_a_frame(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), 1, True)], SCHEMA)
    assert "FlatMapGroupsIn" not in breaker(df)._jdf.queryExecution().toString()
