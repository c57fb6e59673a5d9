import math

import numpy as np
from tesserine.llm import vector_dup as d


def brute(rows, cosine=0.95):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        a = a / np.abs(a).max()
        return a / np.sqrt(a @ a)

    units = [unit(v) for _, v in rows]
    group, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(units):
        for j, b in enumerate(units[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                group[root(i)] = root(j)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((k, links[i], min(ids, default=None), k == min(ids, default=None)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).selectExpr("*", "1 as node", "2 as id", "'x' as unit")
    assert sorted((tuple(r) for r in d.vector_duplicates(df).collect()), key=str) == brute([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows])


def points(n, seed, size=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(1, n // 6), size))
    return [(centres[r.integers(len(centres))] + r.normal(size=size) * 0.25).tolist() for _ in range(n)]


def test_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, []), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.1]), (1, [1.0, 0.0]), (None, [-1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [0.95, 0.45]), (13, [1e-30, 0.0])]
    check(spark, rows)
    assert d.vector_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_cells_parts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(d, "CELL", 40)
    monkeypatch.setattr(d, "GROUP", 25)
    monkeypatch.setattr(d, "BLOCK", 7)
    p = points(300, 1)
    check(spark, [(1000 - i, v) for i, v in enumerate(p + p[:20] + p[:1] * 60)])


def test_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in d.op9_vector_dup(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)


def test_thousands_of_pivots(spark, monkeypatch):
    """Cells of two vectors each: the work of a batch grows with its rows times the pivots, and no link is lost."""
    import numpy as np

    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 24))
    x = np.concatenate([base, base[:700] + rng.normal(size=(700, 24)) * 0.04])
    monkeypatch.setattr(d, "CELL", 1)
    rows = d.vector_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = u @ u.T >= 0.95
    assert {r.vec_id: r.n_links for r in rows} == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}
    assert near.sum() > len(x) + 1000
