import itertools
import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tesserine.llm import packing as p
from tesserine.llm.tokens import vocabulary
from tokenizers import Tokenizer


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece_once_without_gaps(h):
    rows = p.plan(h, 64)
    count, bins = Counter(), {}
    for n, first, k, seq, offset in sorted(rows):
        assert first == count[n]
        count[n] += k
        for i in range(k):
            bins.setdefault(seq + i, []).append((offset, n))
    assert count == Counter(h)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(n * c for n, c in h.items())
    # Of pieces over half of a sequence each needs its own, of those over a third two share one.
    assert len(bins) <= max(-(-total // 64) * 1.35 + 2, sum(c if n > 32 else c / 2 for n, c in h.items() if n > 21) + 3)


def fewest(items, capacity):
    """By trying: the fewest sequences for a few pieces."""
    items, best = sorted(items, reverse=True), [len(items)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[k]}:
            i = rooms.index(room)
            put(k + 1, rooms[:i] + [room - items[k]] + rooms[i + 1 :])
        put(k + 1, [*rooms, capacity - items[k]])

    put(0, [])
    return best[0]


def test_few_pieces_take_hardly_more_than_the_fewest():
    r = random.Random(2)
    more = []
    for _ in range(60):
        items = [r.randint(1, 100) for _ in range(r.randint(1, 9))]
        more.append(p.sequences(p.plan(Counter(items), 100)) - fewest(items, 100))
    assert min(more) == 0 and max(more) <= 1 and sum(more) <= 6


def test_configurations_are_optimised():
    """Sizes that fill sequences without rest take no more than their sum; none is over the capacity or the need."""
    used = p.optimised([50, 30, 20], [100, 100, 100], 100)
    assert sum(n for _, n in used) == 100 and [sum(c[i] * n for c, n in used) for i in range(3)] == [100, 100, 100]
    r = random.Random(4)
    for _ in range(20):
        sizes = sorted(r.sample(range(210, 500), 40), reverse=True)
        need = [r.randint(20, 200) for _ in sizes]
        used = p.optimised(sizes, need, 1024)
        taken = [sum(c[i] * n for c, n in used) for i in range(len(sizes))]
        assert all(sum(k * s for k, s in zip(c, sizes)) <= 1024 for c, _ in used) and all(a <= b for a, b in zip(taken, need))
        left = sum((b - a) for a, b in zip(taken, need))
        assert left <= 3 * len(sizes) and any(sum(c) >= 3 for c, _ in used)
        assert sum(n for _, n in used) >= sum(a * s for a, s in zip(taken, sizes)) / 1024


def test_most_worth_by_trying():
    r = random.Random(5)
    for _ in range(40):
        sizes = sorted(r.sample(range(5, 60), 4), reverse=True)
        need, worth = [r.randint(0, 3) for _ in sizes], [r.random() for _ in sizes]
        best = max(sum(n * w for n, w in zip(c, worth)) for c in itertools.product(*(range(n + 1) for n in need)) if sum(n * s for n, s in zip(c, sizes)) <= 100)
        value, counts = p.fullest(np.array(sizes), np.array(worth), np.array(need, float), 100)
        assert abs(value - best) < 1e-9 and abs(sum(n * w for n, w in zip(counts, worth)) - best) < 1e-9 and sum(n * s for n, s in zip(counts, sizes)) <= 100


def test_every_setting_rounds_and_substitutes():
    """Every setting has groups of at least four lengths; its plan places actual pieces and comes near the sum of lengths."""
    r = random.Random(6)
    h = Counter(int(min(1024, max(1, r.gauss(420, 260)))) for _ in range(20000))
    bound = -(-sum(n * c for n, c in h.items()) // 1024)
    for share, groups in p.SETTINGS:
        long = sorted((n for n in h if 1024 * share < n < 1024), reverse=True)
        runs = p.grouped(h, long, min(groups, len(long) // 4))
        assert share < 1 / 3 and len(runs) <= len(long) // 4 and sorted(n for g in runs for n in g) == sorted(long)
        assert bound <= p.sequences(p.grouped_plan(h, 1024, share, groups)) <= 1.005 * bound + 1


def test_near_the_bound_on_many_pieces():
    r = random.Random(3)
    h = Counter(r.randint(1, 1024) for _ in range(30000))
    used = max(x[3] + x[2] for x in p.plan(h))
    assert used <= 1.01 * sum(n * c for n, c in h.items()) / 1024


def check(rows, docs, capacity):
    library = Tokenizer.from_file(vocabulary(p.VOCABULARY))
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    want = {}
    for d, t in docs:
        want.setdefault(d, []).append(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    for d, all_ids in want.items():
        pieces = [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for ids in all_ids for s, n in p.cut_pieces(len(ids), capacity)]
        assert sorted((r.start, r.length, r.ids_crc32) for r in of[d]) == sorted(pieces)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity


def test_cases(spark):
    docs = [(1, "a b c"), (2, None), (3, ""), (4, "word, " * 3000), (None, "x"), (5, "same"), (5, "same"), (6, "w" * 20000), (7, "a <|endoftext|> İ. b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "'x' as task")
    check(p.pack_documents(df, vocabulary(p.VOCABULARY), 64).collect(), docs, 64)
    assert p.pack_documents(df.limit(0), vocabulary(p.VOCABULARY)).collect() == []


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(p.op4_packing(spark, "/root/testdata/sf0.001").collect(), docs, 1024)
