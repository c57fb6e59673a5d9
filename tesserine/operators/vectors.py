"""Vector neighbours: a stated query set against all vectors, in blocks, and vector tables.

Queries are taken in blocks of bounded size, each sent to the executors; a task
multiplies them with its vectors as matrices and keeps the k best of each query,
so what is shuffled is k rows a query and task, and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import upsert
from .text_jobs import top_per_group

#: Bytes of query vectors that are sent at once, and rows of the matrices that a task multiplies at a time.
QUERY_BYTES, ROWS = 8 << 20, 1024


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one as a matrix, and which rows have one: not those that are null, zero or hold null or non-finite numbers."""
    size = column.value_lengths().fill_null(0).to_numpy()
    width = int(size.max(initial=0))
    row = np.repeat(np.arange(len(size)), size)
    flat = column.flatten()  # leaves null rows out
    lacking = np.bincount(row[flat.is_null().to_numpy(zero_copy_only=False)], minlength=len(size)) > 0
    good = (size == width) & (size > 0) & ~lacking
    x = np.zeros((len(size), width))
    x[good] = flat.to_numpy(zero_copy_only=False)[good[row]].reshape(int(good.sum()), width)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    good &= np.isfinite(norm) & (norm > 0)
    x[~good] = 0.0
    x /= np.where(good, norm, 1.0)[:, None]
    return x, good


class _Best:
    """The k best terms of each query among all that were offered; of equal ones, the smaller term."""

    def __init__(self, n: int, k: int, least: float):
        self.k, self.floor = k, np.full(n, least)
        self.query, self.term, self.score, self.size = [], [], [], 0
        self.most = max(1 << 18, n * k)

    def offer(self, first: int, scores: np.ndarray, terms: np.ndarray) -> None:
        """Scores of the queries from `first` on with some terms; -inf is none."""
        least = np.maximum(self.floor[first : first + len(scores), None], np.finfo(np.float64).min)
        if scores.shape[1] > self.k and np.count_nonzero(scores >= least) > self.k * len(scores):
            # What isn't among the k best of these isn't among the k best; ties with the last stay.
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k, None])
        q, t = np.nonzero(scores >= least)
        self.query.append(q + first)
        self.term.append(terms[t])
        self.score.append(scores[q, t])
        self.size += len(q)
        if self.size > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        q, t, s = np.concatenate([none, *self.query]), np.concatenate([none, *self.term]), np.concatenate([np.zeros(0), *self.score])
        order = np.lexsort((t, -s, q))
        q, t, s = q[order], t[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[q[last]] = s[last]
        self.query, self.term, self.score, self.size = [q[keep]], [t[keep]], [s[keep]], 0
        return q[keep], t[keep], s[keep]


def neighbours(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", least: float | None = None) -> DataFrame:
    """query, term, similarity (six places), rank: exact cosine of a query set with all vectors, the query itself left out.

    Ties go by term.  Vectors without a direction, and those of another length
    than the query, are no one's neighbours; null ids are left out.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null").dropDuplicates(["id"])
    size = asked.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    found = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()  # QUERY_BYTES, about
        best = rows.mapInArrow(_search(spark.sparkContext.broadcast(mine), k, -np.inf if least is None else least), "query long, term long, similarity double")
        found = best if found is None else found.unionByName(best)
    return top_per_group(found, ["query"], [F.col("similarity").desc(), "term"], k)


def _search(sent, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        ids = table["id"].to_numpy()
        q, good = _units(table["v"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64())))
        q, ids = q[good], ids[good]
        best = _Best(len(ids), k, least)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, ok = _units(part.column(1))
                terms = part.column(0).to_numpy()[ok]
                if x.shape[1] != q.shape[1] or not len(terms):
                    continue
                own = x[ok]
                for first in range(0, len(ids), ROWS):
                    scores = np.round(q[first : first + ROWS] @ own.T, 6)
                    scores[ids[first : first + ROWS, None] == terms[None, :]] = -np.inf
                    best.offer(first, scores, terms)
        query, term, score = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(term), pa.array(score)], names=["query", "term", "similarity"])

    return run


def term_neighbours(queries: DataFrame, vectors: DataFrame, terms: DataFrame, k: int = 10) -> DataFrame:
    """query, term, similarity, rank: of the 2 k nearest vectors, the first k whose term counts.

    terms holds (vec_id, term).  Terms are trimmed and lower-cased; each counts
    once, the query's own, those with an underscore or digit and those of one
    letter don't.
    """
    near = neighbours(queries, vectors, 2 * k)
    clean = terms.select(F.col("vec_id").alias("id"), F.lower(F.trim("term")).alias("clean"))
    named = near.join(clean, F.col("term") == F.col("id")).drop("id", "term").join(clean.select(F.col("id").alias("query"), F.col("clean").alias("own")), "query", "left")
    kept = named.where(F.coalesce(F.col("clean") != F.col("own"), F.lit(True)) & ~F.col("clean").rlike("[_0-9]") & (F.length("clean") >= 2))
    once = kept.groupBy("query", "clean").agg(F.min("rank").alias("at"), F.max_by("similarity", -F.col("rank")).alias("similarity"))
    return top_per_group(once, ["query"], ["at"], k).select("query", F.col("clean").alias("term"), "similarity", "rank")


def multi_word(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """concept, term, similarity: of the neighbours of a concept's words (concept, word), each term's best similarity, the first k."""
    words = vectors.join(queries.select(F.col("word").alias("vec_id")).distinct(), "vec_id", "left_semi")
    near = neighbours(words, vectors, k + 1).select(F.col("query").alias("word"), "term", "similarity")
    best = queries.join(near, "word").groupBy("concept", "term").agg(F.max("similarity").alias("similarity"))
    return top_per_group(best, ["concept"], [F.col("similarity").desc(), "term"], k)


def apply_operations(vectors: DataFrame, changes: DataFrame, operation: Column, key: str = "vec_id", order: str = "version") -> DataFrame:
    """The vector table after changes: the newest change of a key adds or replaces its vector, or deletes it."""
    last = changes.withColumn("operation", operation)
    kept = upsert(vectors.withColumn("operation", F.lit("add")), last, key, order)
    return kept.where("operation <> 'delete'").drop("operation")
