import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tesserine.llm import token_files as t
from tesserine.llm.shared import new_path
from tesserine.llm.tokens import vocabulary
from tokenizers import Tokenizer


@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**60 - 1)), max_size=400), st.integers(0, 300))
@settings(max_examples=80, deadline=None)
def test_words_hold_all_ids(ids, zeros):
    ids = np.array(ids + [0] * zeros, np.uint64)
    words = t.pack(ids)
    assert (t.unpack(words, len(ids)) == ids).all()
    assert len(words) <= max(1, len(ids))


def check(rows, docs):
    library, at, want = Tokenizer.from_file(vocabulary(t.VOCABULARY)), 0, []
    for d, text in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == want


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK_IDS", 50)
    monkeypatch.setattr(t, "FILE_TEXT", 300)
    monkeypatch.setattr(t, "RUN", 3)
    docs = [(3, "a b c"), (-2, None), (5, ""), (4, "word, " * 3000), (None, "x"), (9, "same"), (9, "same"), (2**40, "w" * 20000)] + [(i, f"text number {i}") for i in range(20, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as words").repartition(3)
    path = new_path(spark, "t")
    t.write_token_files(df, path, vocabulary(t.VOCABULARY))
    check(t.read_token_files(spark, path).collect(), docs)
    path = new_path(spark, "t")
    t.write_token_files(df.limit(0), path, vocabulary(t.VOCABULARY))
    assert t.read_token_files(spark, path).collect() == []


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(t.op7_token_files(spark, "/root/testdata/sf0.001").collect(), docs)


def test_equal_and_null_ids_have_an_order(spark, monkeypatch):
    """Rows of one id come in one order, however the table is cut, and rows without an id are in several files."""
    monkeypatch.setattr(t, "FILE_TEXT", 400)
    docs = [(5, f"text {i} " * (i % 7)) for i in range(40)] + [(None, f"other {i}") for i in range(60)] + [(5, None), (5, "")]
    seen = []
    for parts in (1, 4):
        path = new_path(spark, "t")
        t.write_token_files(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), path, vocabulary(t.VOCABULARY))
        seen.append(sorted((tuple(r) for r in t.read_token_files(spark, path).collect()), key=lambda r: r[1]))
    assert seen[0] == seen[1] and len(seen[0]) == len(docs)
    assert [r[1] for r in seen[0]] == [sum(x[2] for x in seen[0][:k]) for k in range(len(docs))]
