import hashlib
import re

import pytest
from tesserine.llm import decontaminate as d

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(docs, items):
    out = {}
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for doc, t in docs:
        w, hit, who = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    who |= found
        out[doc] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))
    return out


def check(spark, docs, items):
    got = d.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    from pyspark.sql import functions as F

    got = got.select("doc_id", "n_words", d.n_hit(F.col("runs")).alias("h"), F.size("items").alias("k"), F.sha2(F.array_join("items", ","), 256).alias("s"), (F.size("items") > 0).alias("c")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(docs, items)


CASES = [(7, " ".join(f"W{i}é" for i in range(30))), (70, "one two, THREE"), (8, ""), (9, "a"), (10, " ".join(f"w{i}é" for i in range(5, 17))), (11, None), (12, "zz zz zz zz zz zz zz zz zz zz zz zz")]


def test_small_cases(spark):
    docs = [(1, "x One! two three y"), (2, None), (3, ""), (4, "pre " + " ".join(f"w{i}é" for i in range(3, 20)) + " post A b"), (5, "zz " * 5000), (6, "onetwo three"), (13, "one two three"), (14, "a" * 3000 + " w0é" * 3)]
    check(spark, docs, CASES)
    check(spark, docs, [(1, None)])
    check(spark, docs, [])


def test_names_nulls_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "one two three", 1, 2, 3, "k"), (4, "x", 1, 2, 3, "k"), (4, "x", 1, 2, 3, "k")], "doc_id long, text string, runs int, items int, n_words int, __text string")
    items = spark.createDataFrame([(70, "one two, THREE"), (70, "one two, THREE"), (None, "x")], "item_id long, text string")
    rows = d.find_items(docs, items, keep=tuple(docs.columns)).collect()
    assert sorted((str(r.doc_id), r.n_words, r["items"], r["__text"], r["text"]) for r in rows) == [("4", 1, [], "k", "x"), ("4", 1, [], "k", "x"), ("None", 3, ["70"], "k", "one two three")]
    assert d.find_items(docs.limit(0), items).collect() == []


def test_random_texts(spark):
    import random

    r = random.Random(3)
    text = lambda n: " ".join(r.choice(("a", "b", "cc", "ddd é", "B,", "x1")) for _ in range(r.randint(0, n)))
    check(spark, [(i, text(80)) for i in range(150)], [(i, text(r.choice((3, 14)))) for i in range(60)])


def test_passes_add_up(spark, monkeypatch):
    monkeypatch.setattr(d, "PASS_BYTES", 40)
    check(spark, [(1, "one two three and a"), (2, "b c " + " ".join(f"w{i}é" for i in range(30)))], CASES)


@pytest.mark.parametrize("table", ["sf0.001"])
def test_whole_tables(spark, table):
    read = lambda n: spark.read.parquet(f"/root/testdata/{table}/{n}.parquet")
    got = {r[0]: tuple(r[1:]) for r in d.op2_decontamination(spark, f"/root/testdata/{table}").collect()}
    assert got == brute([(r.doc_id, r.text) for r in read("documents").collect()], [(r.item_id, r.text) for r in read("benchmark").collect()])
