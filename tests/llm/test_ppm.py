import math
import re
import zlib
from collections import Counter, defaultdict

from tesserine.llm import ppm as p

TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(t):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())


def brute(docs, learned):
    count, follow = Counter(), [defaultdict(Counter) for _ in range(p.ORDER + 1)]
    for i, t in docs:
        if learned(i):
            count.update(TOKEN.findall(lower(t)) + [None])
            data = b"\0" * p.ORDER + lower(t).replace(b"\0", b"\xff") + b"\0"
            for at in range(p.ORDER, len(data)):
                for k in range(p.ORDER + 1):
                    follow[k][data[at - k : at]][data[at]] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in docs:
        words = TOKEN.findall(lower(t)) + [None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        data, score = b"\0" * p.ORDER + lower(t).replace(b"\0", b"\xff") + b"\0", 0.0
        for at in range(p.ORDER, len(data)):
            excluded, s = set(), data[at]
            for k in range(p.ORDER, -1, -1):
                f = follow[k].get(data[at - k : at])
                if not f:
                    excluded = set()  # nothing is excluded below a context that isn't known
                    continue
                total = sum(c for b, c in f.items() if b not in excluded)
                if s in f and s not in excluded:
                    score += math.log10((2 * f[s] - 1) / (2 * total))
                    break
                if total:
                    score += math.log10(len(set(f) - excluded) / (2 * total))
                excluded = set(f)
            else:
                score -= math.log10(256 - len(excluded))
        out.append((i, len(words), sum(count[w] > 0 for w in words), n, base, score))
    return out


def check(rows, docs, learned):
    key = lambda r: (str(r[0]), r[1], r[4])
    want = sorted(brute(docs, learned), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4]
        assert abs(g[4] - w[4]) < 1e-6 * max(1, abs(w[4])) and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))


def test_cases(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(p, "BLOCK", 300)
    monkeypatch.setattr(p, "CHUNK", 100)
    docs = [(1, "The cat sat on the mat"), (2, "the Dog\tsat"), (3, None), (4, ""), (5, "été à la mer  "), (6, "zebra 日本"), (None, "cat"), (1, "the cat"), (8, "ab " * 500), (9, "\0 x\0")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "2 as id", "'x' as learn", "3 as n").repartition(3)
    check(p.score_documents(df, F.col("doc_id") % 3 != 0).collect(), docs, lambda i: i is not None and i % 3 != 0)
    check(p.score_documents(df, F.lit(False)).collect(), docs, lambda i: False)
    assert p.score_documents(df.limit(0), F.lit(True)).collect() == []


def test_probabilities_of_all_bytes_add_up(spark):
    import numpy as np

    table = p.trie_table(spark.createDataFrame([("abracadabra abra",), ("banana band",)], "text string"), slices=3, groups=2)
    levels = [[] for _ in range(p.ORDER + 1)]
    for r in table.where("level > 1").collect():
        levels[r["level"]].append((np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)))
    trie = p.Trie([*p.shortest(table), *(p.added(*map(np.concatenate, zip(*rows))) for rows in levels[2:])])
    for ctx in (b"\0\0abr", b"anana", b"xyzab", b"zzzzz", b"\0\0\0\0\0", b"band "):
        keys = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs((10 ** trie.score(keys)).sum() - 1) < 1e-9


def test_zero_bytes_are_not_the_end():
    assert len(set(p.contexts([b"a\0b", b"a"])[0].tolist())) == 5
    assert p.contexts([b"\0"])[0][0] != p.contexts([b""])[0][0]
    assert len(p.contexts([])[0]) == 0


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = p.op3_ppm(spark, "/root/testdata/sf0.001").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    assert all(r.held_out == held(r.doc_id) for r in rows)
    check(rows, docs, lambda i: not held(i))


def test_blocks_and_parts_of_any_size(spark, monkeypatch):
    """Small blocks, parts dealt to several tasks, counts added up in groups of tasks."""
    from pyspark.sql import functions as F

    for name, value in (("BLOCK", 40), ("LOOSE", 10), ("ASKED_BYTES", 40), ("APART", 20), ("PLACES", 8)):
        monkeypatch.setattr(p, name, value)
    docs = [(i, t) for i, t in enumerate(["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the hog sat"] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(p.score_documents(df, F.col("doc_id") % 3 != 0).collect(), docs, lambda i: i % 3 != 0)
