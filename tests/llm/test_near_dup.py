import math
import random
import re
from collections import Counter

import numpy as np
from tesserine.llm import near_dup as d
from tesserine.llm.textbytes import word_hashes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))


def brute(docs, threshold=0.8):
    """Class of each (id, text) by comparing all distinct texts."""
    bucket = lambda w: int(word_hashes([w])[0][0]) >> (64 - 18)
    df = Counter()
    for _, t in docs:
        df.update({bucket(w) for w in set(words(t))})
    idf = lambda w: math.log((1 + len(docs)) / (1 + df[bucket(w)])) + 1
    sets = {}
    for _, t in docs:
        w = words(t)
        runs = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        sets[t or ""] = {g: n * sum(map(idf, g)) / len(g) for g, n in Counter(runs).items()}
    texts = list(sets)
    group = {t: t for t in texts}

    def root(t):
        while group[t] != t:
            t = group[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            shared = sum(min(v, sets[b].get(g, 0)) for g, v in sets[a].items())
            union = sum(sets[a].values()) + sum(sets[b].values()) - shared
            if union and shared / union >= threshold:
                group[root(a)] = root(b)
    out = {}
    for i, t in docs:
        same = [(k, u) for k, u in docs if t and u and root(u) == root(t)] or [(i, t)]
        out[i, t] = (min((k for k, _ in same if k is not None), default=None), len(same))
    return out


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 as id", "'x' as node", "2 as band")
    rows = d.near_duplicates(df).collect()
    key = {}
    for i, t in docs:
        import hashlib

        key[i, hashlib.md5((t or "").encode()).digest()] = t
    got = {(r.id, key[r.id, bytes(r.node)]): (r.class_id, r.class_size) for r in rows}
    want = brute(docs)
    assert len(rows) == len(docs)
    assert {(i, t or ""): v for (i, t), v in got.items()} == {(i, t or ""): v for (i, t), v in want.items()}
    assert all(r.kept == (r.id == r.class_id) for r in rows if r.class_id is not None)


def family(r, n, edits, size=120):
    base = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(size)] = "".join(r.choice("hijk") for _ in range(5))
        out.append(" ".join(w))
    return out


def test_families_against_all_pairs(spark):
    r = random.Random(8)
    texts = [t for k in range(6) for t in family(r, 12, 6)] + ["unlike " + str(i) * 9 for i in range(5)]
    texts += [texts[0]] * 4 + ["a b c", "A b, c!", "a b d", "x", "y y y y y y y y", "y y y y y y y"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, ""), (903, "!!!"), (None, "lonely text here"), (904, "word " * 60000)]
    check(spark, docs)


def test_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(d, "OUTSIDERS", 3)
    monkeypatch.setattr(d, "OTHERS", 5)
    monkeypatch.setattr(d, "HOT", 4)  # buckets are dealt to several tasks
    r = random.Random(9)
    check(spark, list(enumerate(family(r, 40, 5))))


def test_samples_estimate_similarity():
    r = random.Random(1)
    a, b = family(r, 2, 0, 400)[0], None
    w = a.split()
    w[50:90] = [f"z{i}" for i in range(40)]
    b = " ".join(w)
    idf = np.ones(d.TERMS)
    h, weight, first = d.weighted_shingles([a.encode(), b.encode()], idf)
    true = d.similarity((h[: first[1]], weight[: first[1]]), (h[first[1] :], weight[first[1] :]))
    hits = n = 0
    for seed in range(40):
        s, sketch = d.samples(d.mixed(h + np.uint64(seed)), weight, first)
        differ = int(np.bitwise_or.reduce(sketch[0] ^ sketch[1])).bit_count()
        assert differ <= d.MAY_DIFFER
        hits += (s[0] == s[1]).sum()
        n += d.BANDS
    assert abs(hits / n - true**d.ROWS) < 0.08


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert d.near_duplicates(df).collect() == []
    assert d.without_near_duplicates(df).collect() == []


def test_query_on_a_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = d.op5_near_dup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.class_id, r.class_size) for r in rows} == {i: v for (i, _), v in brute(docs).items()} and len(rows) == len(docs)
    assert {r.doc_id for r in rows if r.kept} == {k for k, _ in brute(docs).values()} and any(r.class_size > 1 for r in rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "same text here", 7), (2, "same text here", 8)], "doc_id long, text string, __key long").selectExpr("*", "1 as __id", "2 as __node")
    assert [tuple(r) for r in d.without_near_duplicates(df).collect()] == [(1, "same text here", 7, 1, 2)]
