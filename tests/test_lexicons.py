import random
import re
from collections import Counter

import numpy as np
from tesserine.operators import lexicons as x


def words(t):
    return re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))


def brute(docs, lexicon):
    """Every run of words of every text against every term."""
    terms = {}
    for tag, term in set(lexicon):
        if tag is not None and term and term.strip():
            terms.setdefault(tuple(words(term)), set()).add((tag, term.lower()))
    found = Counter()
    for i, t in docs:
        w = words(t or "")
        for a in range(len(w)):
            for b in range(a + 1, min(len(w), a + 6) + 1):
                for tag, _ in terms.get(tuple(w[a:b]), ()):
                    found[i, tag] += 1
    return found


def test_against_every_run(spark, monkeypatch):
    r = random.Random(2)
    letters = ["a", "b", "ab", "é", "r&b", "A", "b_", "9", "aé"]
    lexicon = [("t1", "a"), ("t1", "a b"), ("t2", "a  b a"), ("t2", "b a"), ("t3", "b"), ("t3", "R&B"), ("t1", "a"), (None, "a"), ("t4", ""), ("t4", None), ("t5", "é a"), ("t6", "a b a b a b"), ("t7", "&")]
    docs = [(i, r.choice(["", " ", "-- "]) + "".join(r.choice(letters) + r.choice([" ", "-", "  ", ", ", "\n"]) for _ in range(r.choice([0, 1, 3, 40, 900])))) for i in range(150)] + [(7, None), (8, ""), (9, "a b"), (9, "a b"), (None, "a"), (10, "a b " * 60000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as tag", "3 as id").repartition(3)
    table = spark.createDataFrame(lexicon, "tag string, term string")
    want = brute(docs, lexicon)
    for most in (x.MOST, 3):  # one automaton, several
        got = {(r.doc_id, r.tag): r.n for r in x.lexicon_tags(df, table, most=most).collect()}
        assert got == want
    assert x.lexicon_tags(df.limit(0), table).collect() == [] and x.lexicon_tags(df, table.limit(0)).collect() == []


def test_lanes_of_any_length_find_the_same(monkeypatch):
    r = random.Random(3)
    automaton = x.Automaton([b"a", b"a b", b"b a b", b"c c c c c"])
    data, _ = x.plain(["".join(r.choice("abc  ") for _ in range(5000)).encode()])
    want = None
    for lane in (1, 7, 64, 1024, 100_000):
        monkeypatch.setattr(x, "LANE", lane)
        places, terms = automaton.find(data)
        found = sorted(zip(places.tolist(), terms.tolist()))
        want = want or found
        assert found == want
    assert want and automaton.find(np.zeros(0, np.uint8))[0].size == 0


def test_all_lexicons_are_read():
    tags = {t for t, _ in x.entries()}
    assert {t.split("/")[0] for t in tags} == set(x.LEXICONS) and {t.split("/")[1] for t in tags} == {"genre", "role", "quality", "temporal", "theme"}
    assert x.entries("book") == [e for e in x.entries() if e[0].startswith("book/")]
