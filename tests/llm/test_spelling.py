import re
import zlib
from collections import Counter

import pytest
from tesserine.llm import spelling as s


def brute(docs):
    """All pairs of words compared."""
    found = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:j] + b[j + 1 :] == a for j in range(len(b)))

    links = {w: [o for o in words if o != w and near(w, o)] for w in words}
    form = {w: min(links[w], key=lambda o: (-words[o], o)) for w in words if links[w]}
    form = {w: o for w, o in form.items() if words[o] >= 10 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, len(links[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items())


def docs():
    base = ["abcdefgh", "letters", "lettters", "latters", "café" * 2, "naïveté", "ÉCOLIERS", "straßen", "x" * 9, "x" * 10, "×÷×÷×÷×", "w" * 70 + "ab", "w" * 71 + "ab"]
    out = [(i, " ".join(base[k % len(base)] for k in range(i % 17))) for i in range(200)]
    out += [(1000 + i, f"Letters, {'letters ' * 30}abcdefgi. abcdfgi ab1letters") for i in range(40)]
    out += [(3000, "chainaaa chainaaa " + "chainaab " * 40 + "chainabb " * 500)]
    out += [(2000, "abxdfgi abxdfgi latersx latersx"), (None, "letters letters"), (5, None), (6, ""), (7, "letters"), (7, "letters"), (8, "abcdefgh " * 20000), (9, "short a b")]
    return out


@pytest.mark.parametrize("most", [s.PASS_BYTES, 24, 8])
def test_against_all_pairs(spark, most):
    df = spark.createDataFrame(docs(), "doc_id long, text string").selectExpr("*", "1 as n", "'x' as word", "2 as other", "3 as form").repartition(3)
    rows = s.group_spellings(df, most=most).collect()
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows) == (want := brute(docs()))
    assert any(w[3] and w[5] != w[3] for w in want)  # a chain of forms


def test_shards_are_bounded():
    for most in (8, 64, 1000, 1 << 20):
        groups = s.passes({7: 1000, 8: 3, 9: 40, 30: 1}, most)
        assert all(sum(x.blocks * 8 for x in g) <= max(most, 8) for g in groups)
        for size in (7, 8, 9, 30):
            own = [x for g in groups for x in g if x.size == size]
            places = sorted(p for x in own if x.part == 0 for p in range(*x.edits))
            assert places == list(range(size)) and len(own) == (1 if own[0].half is None else 2 * own[0].parts)


def test_filters_rule_out_most_edits(spark):
    words = s.vocabulary(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).cache()
    (shards,) = s.passes({r[0]: r[1] for r in words.selectExpr("length(word) as l").groupBy("l").count().collect()}, s.PASS_BYTES)
    letters = s.np.array(sorted(set("".join(r.word for r in words.collect()).encode("latin-1"))), s.np.uint8)
    passed, pairs = s._probed(words, shards, letters).count(), s.near_pairs(words).count()
    tried = sum(len(r.word) * len(letters) // 2 for r in words.collect())
    assert pairs <= passed <= pairs + 0.005 * tried


def test_empty_table_and_maps(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert s.group_spellings(empty).collect() == []
    df = spark.createDataFrame(docs(), "doc_id long, text string").selectExpr("*", "1 as word", "2 as __row")
    got = s.with_roots(df, s.group_spellings(df)).collect()
    want = {w[0]: w[5] for w in brute(docs()) if w[0] != w[5]}
    assert len(got) == len(docs()) and any(r.roots for r in got)
    for r in got:
        runs = re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if c.isascii() else c for c in r.text or ""))
        assert r.roots == (None if r.text is None else {w: want[w] for w in runs if w in want})
