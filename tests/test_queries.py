"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest
from tesserine import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float) and not isinstance(v, bool):
        return repr(round(v, 5) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in place) for r in cursor.fetchall())


def test_breaker_against_replay(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect()
    state, want = {}, {}
    for r in rows:
        now, run, last = state.get(r.user_id, ("CLOSED", 0, None))
        if now == "OPEN" and (r.ts - last).total_seconds() >= 3600:
            now = "HALF_OPEN"
        if r.event_type != "error":
            now, run = "CLOSED", 0
        else:
            run, last = run + 1, r.ts
            if now == "CLOSED" and run >= 2:
                now = "OPEN"
        state[r.user_id] = (now, run, last)
        want[r.event_id] = now
    assert {r.id: r.state for r in catalog.queries()["l12_breaker"](spark, SF).collect()} == want
