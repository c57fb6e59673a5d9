"""Exact near-duplicate vectors: a metric range join over pivot cells.

Unit vectors with cosine c are sqrt(2 - 2 c) apart, a metric.  Each vector
belongs to the cell of its nearest pivot.  A vector can only be near a member of
another cell q if the triangle inequality allows it: half the difference of its
distances to q and to its own pivot, or its distance to q less the cell's
radius, must not exceed the range; then it is copied to q as well.  (On the unit
sphere the first bound sharpens to the distance from the plane between the two
pivots.)  Each cell is joined on its own.  Of two cells that may hold neighbours
of each other, one sends its vectors to the other, so each pair of vectors of
different cells is compared once, and both get the link.

Equal vectors are one member with a count.  A cell with many members, or many
that may be near them, is dealt to several groups: every part of its members
meets every slice of those, so no group outgrows its task.  A group returns
counts and a spanning forest of the links it found, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import written
from .worker import task

COSINE = 0.95
#: Vectors a cell, about, and bytes of pivots, at most (they are sent to every executor).
CELL, PIVOT_BYTES = 4096, 16 << 20
#: Members of a cell that one group searches for, and vectors that it searches among; larger cells take several groups.
GROUP = 8192
#: Rows of the matrices that a task multiplies at a time, and what single precision may be wrong by.
BLOCK, SLACK = 512, 1e-5


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, node (digest), unit (doubles as bytes; null where the vector is null, empty, zero or has null or non-finite components)."""

    def normed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            units, nodes = [], []
            for v in b.column(1).to_pylist():
                a = None
                if v and None not in v:
                    a = np.array(v, np.float64)
                    n = math.sqrt(float(a @ a)) if np.isfinite(a).all() else 0.0
                    if not (0 < n < math.inf):  # scaled first where squares leave the range
                        top = float(np.abs(a).max()) if np.isfinite(a).all() else 0.0
                        a = a / top if top > 0 else None
                        n = math.sqrt(float(a @ a)) if a is not None else 0.0
                    a = a / n if a is not None and n > 0 else None
                units.append(a.tobytes() if a is not None else None)
                nodes.append(hashlib.md5((a + 0.0).tobytes()).digest() if a is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(units, pa.binary())], names=["id", "node", "unit"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(task(normed), "id long, node binary, unit binary")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _links(nodes: DataFrame, size: int, cosine: float, n: int) -> DataFrame:
    """node, links (rows of other members near it), root (a member of its local component), for all members (node, n, unit) of one length.

    A member may have several rows, whose links add up; links is null in rows
    that only tell a root.
    """
    spark = nodes.sparkSession
    reach = math.sqrt(2 - 2 * cosine) + 1e-9
    picked = nodes.orderBy(F.xxhash64(F.substring("node", 10, 16)), "node").limit(max(1, min(PIVOT_BYTES // (8 * size), n // CELL))).select("unit").collect()
    sent = spark.sparkContext.broadcast(np.stack([np.frombuffer(r["unit"], np.float64) for r in picked]))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        for b in batches:
            x = _matrix(b.column(2), size)
            d = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
            home = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(d[np.arange(len(x)), home])], names=["node", "n", "unit", "home", "distance"])

    homes = written(nodes.mapInArrow(task(celled), "node binary, n long, unit binary, home int, distance double"), "vector-cells")
    cells = {r["home"]: (r["radius"], r["members"]) for r in homes.groupBy("home").agg(F.max("distance").alias("radius"), F.count("*").alias("members")).collect()}  # a row a pivot
    limits = spark.sparkContext.broadcast(np.array([cells.get(q, (-10.0, 0))[0] for q in range(len(picked))]))

    def near(x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Whether each vector must be copied to each cell."""
        pivots = sent.value
        d = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
        own = d[np.arange(len(x)), home][:, None]
        apart = np.sqrt(np.maximum(1e-12, 2 - 2 * pivots[home] @ pivots.T))  # of these rows' pivots only
        out = (d <= limits.value + reach) & (d * d - own * own <= 2 * apart * reach)
        # Of two cells, that with the smaller number sends where their sum is even, the other where it is odd.
        q = np.arange(len(pivots))
        out &= (q > home[:, None]) == ((q + home[:, None]) % 2 == 0)
        out[np.arange(len(x)), home] = True
        return out

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for b in batches:
            total += near(_matrix(b.column(2), size), b.column(3).to_numpy()).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["cell", "copies"])

    copies = {r["cell"]: r["copies"] for r in homes.mapInArrow(task(counted), "cell int, copies long").groupBy("cell").agg(F.sum("copies").alias("copies")).collect()}  # a row a pivot
    parts = np.array([max(1, -(-cells.get(q, (0, 0))[1] // GROUP)) for q in range(len(picked))])
    slices = np.array([max(1, -(-copies.get(q, 0) // GROUP)) for q in range(len(picked))])
    dealt = spark.sparkContext.broadcast((parts, slices))

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, slices = dealt.value
        for b in batches:
            home = b.column(3).to_numpy()
            code = np.frombuffer(b"".join(v[9:17] for v in b.column(0).to_pylist()), "<u4").reshape(-1, 2).astype(np.int64)
            # As one that searches: in its part, once for each slice of its own cell.
            row = np.repeat(np.arange(len(home)), slices[home])
            cell = home[row]
            piece = np.arange(len(row)) - np.repeat(np.cumsum(slices[home]) - slices[home], slices[home])
            part = code[row, 0] % parts[cell]
            there = piece == code[row, 1] % slices[cell]
            # As one to be found: in its slice, once for each part of each cell, save where it is already.
            row2, cell2 = np.nonzero(near(_matrix(b.column(2), size), home))
            times = parts[cell2]
            part2 = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row2, cell2 = np.repeat(row2, times), np.repeat(cell2, times)
            new = (cell2 != home[row2]) | (part2 != code[row2, 0] % parts[cell2])
            row2, cell2, part2 = row2[new], cell2[new], part2[new]
            rows = pa.array(np.concatenate((row, row2)))
            columns = ((cell, cell2), (part, part2), (piece, code[row2, 1] % slices[cell2]))
            flags = ((np.ones(len(row), bool), np.zeros(len(row2), bool)), (there, np.ones(len(row2), bool)), (np.zeros(len(row), bool), cell2 != home[row2]))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(3)), *(pa.array(np.concatenate(c), pa.int32()) for c in columns), *(pa.array(np.concatenate(f)) for f in flags)], names=["node", "n", "unit", "cell", "part", "piece", "mine", "there", "visits"])

    def joined(table: pa.Table) -> pa.Table:
        nodes, counts = table["node"].to_pylist(), table["n"].to_numpy()
        x = _matrix(table["unit"].combine_chunks(), size)
        single = x.astype(np.float32)
        mine, there = (np.flatnonzero(table[c].to_numpy(zero_copy_only=False)) for c in ("mine", "there"))
        visits = table["visits"].to_numpy(zero_copy_only=False)
        among = single[there].T
        label = np.arange(len(nodes))
        links = np.zeros(len(nodes), np.int64)
        for k in range(0, len(mine), BLOCK):
            i, j = np.nonzero(single[mine[k : k + BLOCK]] @ among >= cosine - SLACK)
            rows, found = mine[k + i], there[j]
            other = rows != found
            rows, found = rows[other], found[other]
            for at in range(0, len(rows), 1 << 16):  # exactly, in double precision
                r, f = rows[at : at + (1 << 16)], found[at : at + (1 << 16)]
                near = np.einsum("ij,ij->i", x[r], x[f]) >= cosine
                r, f = r[near], f[near]
                links += np.bincount(r, counts[f], len(nodes)).astype(np.int64)
                v = visits[f]
                links += np.bincount(f[v], counts[r[v]], len(nodes)).astype(np.int64)
                for a, run in zip(r[np.flatnonzero(np.diff(r, prepend=-1))], np.split(f, np.flatnonzero(np.diff(r)) + 1) if len(r) else ()):
                    met = np.unique(np.append(label[run], label[a]))
                    if len(met) > 1:
                        label[np.isin(label, met)] = met[0]
        told = np.concatenate((mine, np.flatnonzero(visits & (links > 0))))
        linked = np.flatnonzero(np.bincount(label, minlength=len(nodes))[label] > 1)
        return pa.table({"node": pa.array([nodes[i] for i in (*told, *linked)], pa.binary()), "links": pa.array([*links[told].tolist(), *[None] * len(linked)], pa.int64()), "root": pa.array([nodes[i] for i in (*told, *label[linked])], pa.binary())})

    dealt_out = homes.mapInArrow(task(copied), "node binary, n long, unit binary, cell int, part int, piece int, mine boolean, there boolean, visits boolean")
    return dealt_out.groupBy("cell", "part", "piece").applyInArrow(joined, "node binary, links long, root binary")


def vector_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    n_links counts the other rows within the cosine (equal vectors among them);
    component_id is the smallest id reachable by links.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths.  Repeated rows link with each other; a null id
    is a component's id only where the component has no other.
    """
    spark = vectors.sparkSession
    rows = written(unit_vectors(vectors, id_col, vector_col), "unit-vectors")
    # Equal vectors: one node with their count. Its label begins with its smallest id, so that of a component's labels the smallest has the component's id.
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("unit").alias("unit"))
    nodes = written(nodes.select(_label("least", "node").alias("node"), F.col("node").alias("digest"), "n", "unit", (F.octet_length("unit") / 8).cast("int").alias("size")), "vector-nodes")
    found = spark.createDataFrame([], "node binary, links long, root binary")
    for r in nodes.groupBy("size").agg(F.count("*").alias("n")).collect():  # a row for each length of vectors
        found = found.unionByName(_links(nodes.where(F.col("size") == r["size"]).select("node", "n", "unit"), r["size"], cosine, r["n"]))
    found = written(found, "vector-links")
    classes = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))

    links = found.groupBy("node").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    known = nodes.select("node", "digest", "n").join(links, "node").join(classes.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left")
    known = known.select("digest", (F.col("links") + F.col("n") - 1).alias("n_links"), _label_id(F.coalesce("component", "node")).alias("component_id"))
    out = rows.join(written(known, "vector-classes"), F.col("node") == F.col("digest"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _label(least: str, node: str) -> F.Column:
    """A node's digest behind its smallest id, in the order of ids, null last: a byte, and the id as an unsigned number."""
    id_ = F.unhex(F.lpad(F.hex(F.coalesce(F.col(least), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(F.when(F.col(least).isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), id_, F.col(node))


def _label_id(label: F.Column) -> F.Column:
    """The id in a label, null where it has none."""
    number = F.conv(F.hex(F.substring(label, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.hex(F.substring(label, 1, 1)) == "00", number)


def op9_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_U = "list_transform(embedding, lambda x: x::DOUBLE)"
#: All pairs by cosine in double precision, then labels that sink to the smallest along the links.
_ORACLE = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(u, lambda x: x / n) AS u FROM (SELECT vec_id, {_U} AS u, sqrt(list_dot_product({_U}, {_U})) AS n FROM embeddings) WHERE n > 0 AND isfinite(n)),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.u, b.u) >= 0.95),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
 SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM (SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE reach.a = vec_id) AS component_id FROM embeddings)"""
QUERIES = {"op9_vector_dup": op9_vector_dup}
ORACLES = {"op9_vector_dup": _ORACLE}
