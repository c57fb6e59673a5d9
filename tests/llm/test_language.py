import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tesserine.llm import language as g

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def field(spark):
    return g.language_field(spark.read.parquet(f"{SF}/documents.parquet"))


def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    n = 3
    f = g.Field(["a", "b", "c"], None, None, None, None, None, rng.normal(size=(n, n)), rng.normal(size=n))
    lines = np.array([0] * 4 + [1] + [2] * 3 + [5] * 5)
    scores = rng.normal(size=(len(lines), n)).astype(np.float32) * 2
    moved = np.zeros((n, n))
    start, size = g.chained(lines)
    got = f.marginals(scores, start, size, moved)
    want, moves = np.zeros((len(lines), n)), np.zeros((n, n))
    for s, k in zip(start, size):
        ways = []
        for path in itertools.product(range(n), repeat=int(k)):
            x = f.begin[path[0]] + sum(scores[s + t, y] for t, y in enumerate(path)) + sum(f.moves[a, b] for a, b in zip(path, path[1:]))
            ways.append((path, np.exp(x)))
        z = sum(w for _, w in ways)
        for path, w in ways:
            for t, y in enumerate(path):
                want[s + t, y] += w / z
            for a, b in zip(path, path[1:]):
                moves[a, b] += w / z
    assert np.abs(got - want).max() < 1e-6 and np.abs(moved - moves).max() < 1e-6


def test_features_by_hand():
    words = g.Words.of([b"Ab xyz\nq", "É".encode()])
    assert words.text.tolist() == [0, 0, 0, 1] and np.diff(words.line).tolist() == [0, 1, 1]

    def code(x):
        return np.array([int.from_bytes(x, "big")], np.uint32)

    want = []
    for w in (b"ab", b"xyz", b"q", "é".encode()):
        edged, rows = b" " + w + b" ", []
        for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77), (4, 0xC2B2AE3D)):
            rows += [g.Words._row(code(edged[k : k + n]), salt)[0] for k in range(len(edged) - n + 1)]
        for k, salt in ((1, 0x27D4EB2F), (2, 0x165667B1), (3, 0xD3A2646C)):
            if len(w) >= k:
                rows += [g.Words._row(code(w[:k]), salt)[0], g.Words._row(code(w[-k:]), salt ^ 0x5BD1E995)[0]]
        want.append(sorted(rows))
    got = [[] for _ in want]
    for rows, own, first in words.groups:
        for w, part in zip(own, np.split(rows, first[1:])):
            got[w] += part.tolist()
    assert [sorted(x) for x in got] == want


def test_chains_are_cut():
    start, size = g.chained(np.array([0] * 300 + [1] * 2 + [4] * 128))
    assert start.tolist() == [0, 128, 256, 300, 302] and size.tolist() == [128, 128, 44, 2, 128]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    rows = g.op13_language(spark, f"/root/testdata/{sf}").collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held)
    print(sf, right)
    assert right > 0.99


def test_switched_text_is_labelled_word_by_word(spark, field):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("crc32(cast(doc_id as string)) % 4 = 2 and lang is not null and length(text) between 200 and 3000").limit(80).collect()
    rng, right, total = np.random.default_rng(2), 0, 0
    for _ in range(60):
        texts, want = [], []
        for k in rng.choice(len(docs), 3):
            words = docs[k].text.replace("\n", " ").split()[:25]
            texts.append(" ".join(words))
            want += [docs[k].lang] * len(g.Words.of([texts[-1].encode()]).hashes)
        ((_, _, runs),) = field.predict([" ".join(texts).encode()])
        got = [x for first, n, x in runs for _ in range(n)]
        assert len(got) == len(want) and [r[0] for r in runs] == [sum(r[1] for r in runs[:k]) for k in range(len(runs))]
        right, total = right + sum(a == b for a, b in zip(got, want)), total + len(want)
    print(right / total)
    assert right / total > 0.93


def test_learns_only_outside_the_fold(spark, field):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("text", F.when(g.remainder("doc_id", 4) == 2, "zzz").otherwise(F.col("text"))).withColumn("lang", F.when(g.remainder("doc_id", 4) == 2, "xx").otherwise(F.col("lang")))
    again = g.language_field(other)
    assert again.langs == field.langs and np.array_equal(again.table, field.table) and "xx" not in again.langs


def test_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 2 else 1000), f"l{i % 3}") for i in range(300)] + [(7, "y", "l1"), (7, "y", "l1")], "doc_id long, text string, lang string")
    monkeypatch.setattr(g, "SAMPLE_LANG", 16)
    monkeypatch.setattr(g, "SAMPLE_BYTES", 5000)
    texts, langs = g.labelled_sample(docs, F.lit(True))
    assert sum(map(len, texts)) <= 5000 and len(texts) <= 48 and set(langs) == {"l0", "l1", "l2"}
    assert (texts, langs) == g.labelled_sample(docs.repartition(5), F.lit(True))


def test_cases(spark, field):
    long = "the and with that have this from " * 40000
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 -- !?", "x"), (4, "— ½ …", None), (5, long, "x"), (5, long, "x"), (None, "日本語", "x"), (6, "w" * 600000, "x"), (7, "the of", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").selectExpr("*", "1 as __text", "2 as lang_pred").repartition(2)
    got = {(r.doc_id, r.text): r for r in g.predict_languages(df, field, runs="spoken").collect()}
    assert len(got) == 8
    for i, t, _ in rows:
        r = got[i, t]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and r["__text"] == 1
        assert sum(x.words for x in r.spoken) == (0 if r.lang_pred == "und" else len(g.Words.of([t.encode()]).hashes) if i != 6 else 3)
    assert g.predict_languages(df.limit(0), field).collect() == []
    for few in (df.limit(0).selectExpr("doc_id", "text", "'a' as lang"), spark.createDataFrame([(1, "a b", "xx"), (3, None, "yy")], "doc_id long, text string, lang string")):
        none = g.language_field(few)
        assert {r.lang_pred for r in g.predict_languages(df, none).collect()} <= {"und", "xx"}
