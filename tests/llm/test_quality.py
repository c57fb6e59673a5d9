import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tesserine.llm import quality as q


def brute(net, text):
    padded = text.ljust(q.CHUNK, b"\0")
    while (len(padded) - q.CHUNK) % q.STEP:
        padded += b"\0"
    acts = []
    for i in range(0, len(padded) - q.CHUNK + 1, q.STEP):
        before = range(max(0, i - q.BACK), i)
        mark = max([(padded[k : k + q.STEP] == padded[i : i + q.STEP]) + (padded[k : k + q.CHUNK] == padded[i : i + q.CHUNK]) for k in before], default=0)
        acts.append(np.maximum(sum(net.tables[j, padded[i + j]].astype(float) for j in range(q.CHUNK)) + net.tables[q.CHUNK, mark] + net.bias, 0))
    feats = np.concatenate((np.max(acts, axis=0), np.mean(acts, axis=0), [1]))
    return 1 / (1 + np.exp(-feats @ net.out))


def test_scores_cover_whole_texts(monkeypatch):
    net = q.fit([b"good text here", b"*** bad ***"] * 20, [1, 0] * 20)
    texts = [b"", b"a", b"12345678", b"123456789", b"good text " * 50 + b"***", bytes(range(256)) * 3, b"aba aba abcd aba abcd " * 9]
    want = [brute(net, t) for t in texts]
    assert np.allclose(net.score(texts), want, atol=1e-5)
    monkeypatch.setattr(q, "PART", 16)
    assert np.allclose(net.score(texts), want, atol=1e-5)
    assert net.score([b"good text here"])[0] > 0.7 > 0.3 > net.score([b"*** bad ***"])[0]


def test_query_scores_each_document(spark):
    """The query's rows against the network by hand, on a whole table."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    net = q.quality_network(docs, spark.read.parquet(f"{d}/labels.parquet"))
    got = {r.doc_id: r for r in q.op1_quality(spark, d).collect()}
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert got.keys() == text.keys()
    for i, t in text.items():
        assert abs(got[i].score - brute(net, t)) < 1e-4
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == (got[i].score >= 0.3)


def test_sample_is_bounded_and_takes_long_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 2 else 1000)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 > 1) for i in range(40)], "doc_id long, quality boolean")
    monkeypatch.setattr(q, "SAMPLE_BYTES", 8000)
    texts, y = q.labelled_sample(docs, labels, F.lit(True))
    assert sum(map(len, texts)) <= 8000 and max(map(len, texts)) == 1000 and set(y) == {0, 1}


def test_cases(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", None), (None, "t", "x"), (1, "a b", "x"), (5, "zz " * 200000, "x")], "doc_id long, text string, score string").withColumn("__text", F.lit(7))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 1)], "doc_id long, quality int")
    net = q.quality_network(docs, labels)
    rows = q.score_quality(docs, net).collect()
    assert sorted((str(r.doc_id), r["__text"], round(r.score, 3)) for r in rows) == sorted((str(i), 7, round(float(net.score([(t or "").encode()])[0]), 3)) for i, t in docs.select("doc_id", "text").collect())
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1  # null as empty
    assert q.score_quality(docs.limit(0), q.quality_network(docs.limit(0), labels.limit(0))).collect() == []


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_held_out_accuracy(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = q.op1_quality(spark, d).collect()
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in y]
    bad = [r for r in held if y[r.doc_id] == 0]
    good = [r for r in held if y[r.doc_id] == 1]
    caught = sum(r.predicted == 0 for r in bad) / len(bad)
    kept = sum(r.predicted for r in good) / len(good)
    auc = np.mean([(g.score > b.score) + 0.5 * (g.score == b.score) for g in good for b in bad])
    print(caught, kept, auc)
    assert caught > 0.9 and kept > 0.97 and auc > 0.97


def test_an_id_with_two_labels_counts_as_the_worse(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    for parts in (1, 3):
        assert sorted(zip(*q.labelled_sample(docs, labels.repartition(parts), F.lit(True)))) == [(b"a", 0), (b"b", 1)]
