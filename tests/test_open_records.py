import json

from pyspark.sql import functions as F
from tesserine.operators import open_records as o


def flat(v):
    """Any value as text, by hand."""
    if isinstance(v, dict):
        v = [v[k] for k in sorted(v)]
    if isinstance(v, list):
        return " ".join(flat(x) for x in v if x is not None)
    return v if isinstance(v, str) else str(v)


ITEMS = [
    {"Id": 1, "Name": "a", "New Field": "words of a plain text", "x.y": [1, [2, [3, {"k": "dp"}]], {}], "flag": True, "none": None, "e": "", "l": [], "s": {}},
    {"Id": 2, "Name": "b", "TYPE": "t", "people": [{"Nickname": "x", "TYPE": 1}, 7], "tags": ["", "ab", "cdé"], "short": ["ab"], "ids": {"isbn": 1, "Doi": 2, "n": 3}, "mixed": {"a": 1, "url": 2}},
    {"Id": 3, "Name": "c", "year": "1999", "n": -1.5, "u": "https://a.b/1234567890/1234567", "guid": "123e4567-e89b-12d3-a456-426614174000", "q": 'say "hi": [1, {2}], \\ ok', "cjk": "日本語日本語日本語日本語"},
    {"Id": 4, "Name": "d", "long": 'né "\n\\' * 200_000},
]


def frame(spark):
    rows = [(k, json.dumps(x, ensure_ascii=k % 2 == 0)) for k, x in enumerate(ITEMS)] + [(10, None), (11, ""), (12, "[1]"), (13, '{"Id": 1}'), (14, '{"Id": 1, "Name": ""}'), (15, "{"), (16, '{"Id": null, "Name": null}')]
    return spark.createDataFrame(rows, "k long, raw string").selectExpr("*", "1 as value", "2 as field", "3 as entity")


def test_reasons(spark):
    got = {r.k: r.reason for r in o.parsed(frame(spark)).collect()}
    assert got == {**dict.fromkeys(range(4)), 10: "not JSON", 11: "not JSON", 12: "not an object", 13: "without Name", 14: "without Name", 15: "not JSON", 16: "without Id, Name"}


def test_fields_of_any_depth(spark):
    fields = o.open_fields(o.parsed(frame(spark)).where("k < 10"), "k")
    got = {(r.entity, r.field): r.text for r in o.open_profile(fields).collect()}
    want = {(k, f): flat(v) for k, x in enumerate(ITEMS) for f, v in x.items() if f.lower() not in ("id", "name", "type") and v not in (None, "", [])}
    assert got == want


def test_types(spark):
    fields = o.open_fields(o.parsed(frame(spark)).where("k < 10"), "k")
    got = {r.field: (r.field_type, r.weight, r.expandable) for r in o.open_profile(fields).collect()}
    assert got == {
        "New Field": ("TEXT_CONTENT", 0.3, True), "x.y": ("METADATA", 0.3, False), "flag": ("METADATA", 0.3, False), "s": ("STRUCTURAL", 0.3, False), "people": ("PEOPLE", 0.6, False), "tags": ("TEXT_CONTENT", 0.6, True), "short": ("METADATA", 0.3, False),
        "ids": ("IDENTIFIERS", 0.0, False), "mixed": ("STRUCTURAL", 0.3, False), "year": ("METADATA", 0.3, False), "n": ("METADATA", 0.3, False), "u": ("IDENTIFIERS", 0.0, False), "guid": ("IDENTIFIERS", 0.0, False), "q": ("UNKNOWN", 0.3, False), "cjk": ("UNKNOWN", 0.3, False), "long": ("UNKNOWN", 0.3, False),
    }


def test_catalog_and_empty(spark):
    fields = o.open_fields(o.parsed(frame(spark)).where("k < 10"), "k")
    got = {r.field: (r.records, r.kinds) for r in o.field_catalog(fields).collect()}
    assert got["x.y"] == (1, "ARRAY") and got["n"] == (1, "DECIMAL") and got["year"] == (1, "STRING")
    empty = o.parsed(frame(spark).limit(0))
    assert o.open_profile(o.open_fields(empty, "k")).collect() == []
    assert o.open_fields(o.parsed(frame(spark)).withColumn("item", F.lit(None).cast("variant")), "k").collect() == []
