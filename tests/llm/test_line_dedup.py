import random

import numpy as np
from tesserine.llm import line_dedup as d


def brute(docs, least):
    """Every run of at least `least` words that occurred before, by (id, hash order of rows given), loses its lines."""
    seen, out = set(), {}
    for key, text in docs:
        lines = text.split("\n") if text else []
        solid = [i for i, line in enumerate(lines) if line.strip()]
        gone = set()
        for x in range(len(solid)):
            n = 0
            for y in range(x, len(solid)):
                n += len(lines[solid[y]].split())
                if n >= least:
                    run = tuple(" ".join(lines[k].split()) for k in solid[x : y + 1])
                    if run in seen:
                        gone |= set(range(solid[x], solid[y] + 1))
                    seen.add(run)
        out[key] = (len(lines), len(gone), "\n".join(line for i, line in enumerate(lines) if i not in gone) if text else text)
    return out


def test_windows_reach_all_lines():
    assert d.windows([3, 3, 3], 5) == [(0, 2), (1, 3)]
    assert d.windows([9], 5) == [(0, 1)]
    assert d.windows([1, 1], 5) == []


def test_against_all_runs(spark):
    r = random.Random(4)
    pool = [" ".join(r.choice("abcdefgh") * 3 for _ in range(r.randint(0, 6))) + str(i) for i in range(12)]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(40)]
    passage = "\n".join(f"line {i} of a shared passage" for i in range(4))
    docs += [(100, "x\n" + passage), (101, passage + "\ny y y"), (102, None), (103, ""), (104, "  " + passage.replace("\n", " \n")), (105, "long " * 50000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 as n_lines", "'z' as first", "0 as __h2", "1 as __h", "2 as __id", "3 as __gone", "4 as lines")
    rows = d.dedup_lines(df, 8).collect()
    assert {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in rows} == brute(docs, 8)
    assert {(x["first"], x["__h2"], x["__h"], x["__id"], x["__gone"], x["lines"]) for x in rows} == {("z", 0, 1, 2, 3, 4)}


def test_a_line_of_many_texts_joins_once(spark):
    common = "the same line in all of these texts here"
    docs = [(i, f"own {i} a b c\n{common}\nlast {i} x y z") for i in range(300)] + [(900 + i, f"x{i}\nown 7 a b c\n{common}\nlast 7 x y z\ny{i}") for i in range(3)]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in d.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 12).collect()}
    assert got == brute(docs, 12) and sum(n for _, n, _ in got.values()) == 9


def test_extends_both_ways():
    a, b = np.array([1, 2, 3, 4, 5, 9]), np.array([7, 2, 3, 4, 5, 6])
    assert d.extended(a, b, [(2, 2), (3, 3)]) == [(1, 5)]
    assert d.extended(np.array([5, 5, 5]), np.array([5, 5, 5]), [(1, 0)]) == [(1, 3)]


def test_repeated_rows_and_nulls(spark):
    t = "one two three\nfour five six"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_removed, x.text) for x in d.dedup_lines(df, 5).collect())
    assert got == [("1", 2, ""), ("1", 2, ""), ("2", 2, ""), ("None", 0, t)]
    assert d.dedup_lines(df.limit(0)).collect() == []


def test_whole_table(spark):
    docs = sorted((x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in d.op10_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(docs, d.MIN_WORDS)
    assert sum(n for _, n, _ in got.values()) > 10


def texts_of(spark, docs, least):
    rows = []
    for i, t in docs:
        hashes, counts, numbers, prints = d.fingerprints(t, least)
        rows.append((i, i, hashes, counts, numbers, [(f, p, g) for f, p, g in prints]))
    return spark.createDataFrame(rows, "id long, h long, lines array<long>, words array<int>, numbers array<int>, prints array<struct<fp:long,place:int,digest:binary>>")


def test_fingerprints_decide_what_travels(spark, monkeypatch):
    """Of texts that share one passage and single lines, few windows are candidates; with fingerprints that tell nothing, all would be."""
    r = random.Random(8)
    passage = [f"passage line {k} of five words" for k in range(12)]
    docs = []
    for i in range(60):
        lines = [f"line {i} {k} {r.random()} text" for k in range(40)]
        lines[5] = "a line that all of them have"
        docs.append((i, "\n".join(lines[:20] + (passage if i < 3 else []) + lines[20:])))
    texts = texts_of(spark, docs, 25)
    windows = texts.selectExpr("inline(prints)")
    every, positions = windows.count(), windows.selectExpr("fp", "place").distinct().count()
    found = d.candidates(texts).collect()
    assert positions < 0.6 * every and len(found) < 0.25 * every
    shared = {g for _, _, g in d.fingerprints("\n".join(passage), 25)[3]}
    assert all(shared <= {bytes(x.digest) for x in found if x.id == i} for i in range(3))
    plain = d.fingerprints
    monkeypatch.setattr(d, "fingerprints", lambda t, n: (*plain(t, n)[:3], [(0, p, g) for _, p, g in plain(t, n)[3]]))
    assert d.candidates(texts_of(spark, docs, 25)).count() == every


def test_a_very_long_text_and_clashing_names(spark):
    block = "\n".join(f"row {k} of a block that comes again" for k in range(9))
    long = "\n".join(f"line {k} with some words of its own" for k in range(30_000))
    docs = [(1, long + "\n" + block), (2, block + "\n" + long[: len(long) // 2])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as place", "3 as digest", "4 as source", "5 as at")
    rows = {x.doc_id: x for x in d.dedup_lines(df, 40).collect()}
    assert rows[1].n_removed == 0 and rows[1].text == docs[0][1] and (rows[2].fp, rows[2].place, rows[2].digest, rows[2].source, rows[2]["at"]) == (1, 2, 3, 4, 5)
    assert rows[2].text == docs[1][1].split("\n")[-1] and rows[2].n_removed == len(docs[1][1].split("\n")) - 1
