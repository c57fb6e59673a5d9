import re

from pyspark.sql import functions as F
from tesserine.operators import detect

TEXTS = ["12 days, 1st 2nd, 1990s 1990 2001-02-03 10:30 next year\n1990s\nnow", "last week, this month; weekly yearly daily", "currently formerly once soon upcoming previously today", "3 hours 4 minutes 21st 3rd", "nowhere knows, best worst 99", "no expression", ""]


def test_what_a_match_holds():
    assert len(detect.HELD) == len(detect.EXPRESSIONS)
    for (_, pattern, _), held in zip(detect.EXPRESSIONS, detect.HELD):
        matches = [m for t in TEXTS for m in re.findall(pattern, t, re.ASCII)]
        assert matches
        assert all(not held or any(h in m for h in held) for m in matches)
        assert "[0-9]" not in pattern or all(re.search("[0-9]", m) for m in matches)


def test_patterns_run_only_where_they_may_match(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, text string").select("i", detect.expressions(F.col("text")).alias("e"))
    got = {r.i: r.e and [tuple(x) for x in r.e] for r in df.collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i] or []) == [(k, v or re.sub("^([0-9]{4})s$", r"\1", m), m) for k, p, v in detect.EXPRESSIONS for m in re.findall(p, t, re.ASCII)]
    assert got[len(TEXTS)] is None
    assert "Contains(" in df._jdf.queryExecution().analyzed().toString() or "contains(" in df._jdf.queryExecution().analyzed().toString().lower()
