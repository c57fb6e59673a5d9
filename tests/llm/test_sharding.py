import hashlib
import random
import zlib

from tesserine.llm import sharding as s
from tesserine.llm.shared import written


def least_capacity(sizes, n):
    """By trying: the smallest capacity for which a greedy walk needs at most n shards."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        capacity, shards, room = (low + high) // 2, 1, (low + high) // 2
        for x in sizes:
            if x > room:
                shards, room = shards + 1, capacity
            room -= x
        low, high = (low, capacity) if shards <= n else (capacity + 1, high)
    return low


def check(rows, docs, n):
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    groups = {}
    for _, t in docs:
        k = hashlib.md5((t or "").encode()).hexdigest()
        groups[k] = groups.get(k, 0) + size(t)
    shards, of_group = {}, {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        shards.setdefault(r.shard, []).append(r)
        of_group.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(v) == 1 for v in of_group.values())
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    if docs:
        assert max(sum(r.size for r in m) for m in shards.values()) == least_capacity([groups[k] for k in sorted(groups)], n)


def test_cases(spark):
    docs = [(1, "a"), (2, None), (3, ""), (4, "same"), (5, "same"), (5, "same"), (None, "é" * 40), (7, "long " * 3000)] + [(i, f"text {i % 40} " * (i % 7)) for i in range(20, 140)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as bucket", "'x' as `group`").repartition(3)
    check(s.shard_documents(df, 8).collect(), docs, 8)
    check(s.shard_documents(df, 3).collect(), docs, 3)
    assert s.shard_documents(df.limit(0)).collect() == []


def test_smallest_capacity(spark):
    """Stretches of one digit of some hundred groups, which have to be opened; some groups are as large as a third of all."""
    r = random.Random(6)
    for n, most in ((1, 400), (2, 400), (5, 400), (8, 30), (4, 9000)):
        groups = sorted({f"{r.getrandbits(128):032x}": r.choice((1, 5, 90, most)) for _ in range(400)}.items())
        sizes = [b for _, b in groups]
        table = written(spark.createDataFrame(groups, "`group` string, bytes long"), "t")
        want = least_capacity(sizes, n)
        ends, room = [""], want
        for (g, b), before in zip(groups, ["", *(g for g, _ in groups)]):
            if b > room:
                ends.append(before)
                room = want
            room -= b
        capacity, last = s.cuts(table, n, digits=1)
        assert capacity == want and last[: len(ends) - 1] == ends[1:] and all(g == groups[-1][0] for g in last[len(ends) - 1 :])


def test_few_scans(spark, monkeypatch):
    """The whole table is summed once, opened stretches a few times."""
    calls = []
    sums = s._stretches
    monkeypatch.setattr(s, "_stretches", lambda g, d: calls.append(d) or sums(g, d))
    table = written(spark.range(20000).selectExpr("md5(string(id)) as `group`", "id % 1000 + 1 as bytes"), "t")
    s.cuts(table, 8, digits=2)
    assert calls.count(2) == 1 and len(calls) <= 4


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(s.op8_minimax_shards(spark, "/root/testdata/sf0.001").collect(), docs, 8)


def test_only_dataframe_operations(spark):
    plan = s.op8_minimax_shards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
