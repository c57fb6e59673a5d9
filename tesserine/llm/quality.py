"""Quality classifier: a byte-level convolutional network in numpy.

A filter looks at CHUNK consecutive bytes and at a mark that tells whether they
have just been seen (all of them, the first half, or neither, within the BACK
bytes before): equality of bytes is what a sum over bytes can't express, and
texts that repeat a word again and again consist of it.  Chunks overlap by half
and cover the whole document.  The filters' responses pass a rectifier, their
maxima and means over all chunks of a document are the features of a logistic
output.  As the inputs of a filter are a byte at each place and the mark, a
response is a sum of table entries (one table for each place in the chunk).  The
network learns on the driver from a sample of labelled documents whose size is
bounded by parameters, and scores each text as a whole in the tasks that read it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import chunks, column
from .worker import fresh, task

#: Bytes of a chunk and from one chunk to the next.
CHUNK, STEP = 8, 4
#: Bytes before a chunk in which it is looked for.
BACK = 32
FILTERS = 16
#: Bytes of text that are worked on at a time.
PART = 1 << 18
#: Bounds of the sample that the network learns from: documents, and bytes of them.
SAMPLE_DOCS, SAMPLE_BYTES = 2400, 12 << 20
EPOCHS, BATCH, RATE, PATIENCE = 14, 32, 0.01, 3
THRESHOLD = 0.3


@dataclass
class Network:
    tables: np.ndarray  # CHUNK + 1 x 256 x FILTERS: bytes, and the mark
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS + 1: maxima, means, constant

    @classmethod
    def chunked(cls, texts: list[bytes], leads: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and mark of each chunk, first chunk of each text; of each text, so many bytes as its lead tells only stand before the first chunk."""
        lead = np.zeros(len(texts), np.int64) if leads is None else np.array(leads, np.int64)
        counts = np.array([max(1, -(-(len(t) - n - CHUNK) // STEP) + 1) for t, n in zip(texts, lead.tolist())])
        first = np.concatenate(([0], np.cumsum(counts)))
        sizes = lead + (counts - 1) * STEP + CHUNK
        data = np.frombuffer(b"".join(t.ljust(n, b"\0") for t, n in zip(texts, sizes.tolist())), np.uint8)
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(lead + starts, counts) + (np.arange(first[-1]) - np.repeat(first[:-1], counts)) * STEP
        return np.stack([*(data[at + j] for j in range(CHUNK)), cls.marks(data, starts, at)]), first

    def responses(self, seen: np.ndarray) -> np.ndarray:
        """The rectified responses of each chunk."""
        act = self.tables[0][seen[0]]
        for j in range(1, CHUNK + 1):
            act += self.tables[j][seen[j]]
        act += self.bias
        return np.maximum(act, 0, out=act)

    @staticmethod
    def marks(data: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """2 where all bytes of a chunk stand at most BACK bytes before as well, 1 where those of its first half do, else 0; starts are those of the texts in data."""
        half = np.ndarray(shape=(len(data) - STEP + 1,), dtype=f"<u{STEP}", buffer=data, strides=(1,)).copy()
        low, both = np.zeros(len(half), bool), np.zeros(len(half), bool)
        for back in range(1, min(BACK, len(half) - 1) + 1):
            same = np.zeros(len(half), bool)
            np.equal(half[back:], half[:-back], out=same[back:])
            first = (starts[:, None] + np.arange(back)).ravel()  # what stands before is another text
            same[first[first < len(same)]] = False
            low |= same
            both[:-STEP] |= same[:-STEP] & same[STEP:]
        return low[at].view(np.uint8) + both[at]

    def features(self, act: np.ndarray, first: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(act, first[:-1], axis=0)
        mean = np.add.reduceat(act, first[:-1], axis=0) / np.diff(first)[:, None]
        return np.concatenate((top, mean, np.ones((len(top), 1), np.float32)), axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text, whatever its length; the empty text has one chunk of zero bytes."""
        parts, owner, leads = [], [], []
        for i, t in enumerate(texts):
            for k in range(0, max(1, len(t) - CHUNK + STEP), PART):
                leads.append(min(k, BACK))
                parts.append(t[k - leads[-1] : k + PART + CHUNK - STEP])
                owner.append(i)
        seen, first = self.chunked(parts, leads)
        each = self.features(self.responses(seen), first).astype(np.float64)
        if len(parts) > len(texts):
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            count = np.diff(first)[:, None]
            mean = np.add.reduceat(each[:, FILTERS : 2 * FILTERS] * count, start) / np.add.reduceat(count, start)
            each = np.concatenate((np.maximum.reduceat(each[:, :FILTERS], start), mean, np.ones((len(texts), 1))), axis=1)
        return 1 / (1 + np.exp(-(each @ self.out)))


def fit(texts: list[bytes], labels: list[int], seed: int = 5) -> Network:
    """Gradient descent (Adam) on the logistic loss, until the loss of a tenth of the texts that it doesn't learn from has not fallen for PATIENCE epochs."""
    rng = np.random.default_rng(seed)
    net = Network((rng.normal(size=(CHUNK + 1, 256, FILTERS)) * 0.25).astype(np.float32), np.zeros(FILTERS, np.float32), (rng.normal(size=2 * FILTERS + 1) * 0.1))
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():  # one class: its share is the score
        net.out[:] = 0
        net.out[-1] = 0 if not len(y) else 4 * y[0] - 2
        return net
    chunks_of = [Network.chunked([t])[0] for t in texts]
    params = [net.tables, net.bias, net.out]
    first_m, second_m = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params]
    checked, learned = np.split(rng.permutation(len(y)), [len(y) // 10])
    step, best, least, since = 0, [p.copy() for p in params], np.inf, 0

    def forward(part: np.ndarray) -> tuple[np.ndarray, ...]:
        first = np.concatenate(([0], np.cumsum([chunks_of[i].shape[1] for i in part])))
        seen = np.concatenate([chunks_of[i] for i in part], axis=1)
        act = net.responses(seen)
        feats = net.features(act, first)
        return seen, act, first, feats, 1 / (1 + np.exp(-(feats @ net.out)))

    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(learned), max(1, len(learned) // BATCH)):
            seen, act, first, feats, p = forward(part)
            d = (p - y[part]) / len(part)
            grad_out = feats.T @ d
            back = d[:, None] * net.out
            counts = np.diff(first)
            g = np.repeat((back[:, FILTERS : 2 * FILTERS] / counts[:, None]).astype(np.float32), counts, axis=0)
            for i, (a, b) in enumerate(zip(first[:-1], first[1:])):  # the chunk that was the maximum
                g[a + act[a:b].argmax(axis=0), np.arange(FILTERS)] += back[i, :FILTERS]
            g *= act > 0
            grad = np.empty_like(net.tables)
            for j in range(CHUNK + 1):
                for f in range(FILTERS):
                    grad[j, :, f] = np.bincount(seen[j], g[:, f], 256)
            step += 1
            for q, m, v, h in zip(params, first_m, second_m, (grad, g.sum(axis=0), grad_out)):
                m += 0.1 * (h - m)
                v += 0.001 * (h * h - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        loss = 0.0
        for k in range(0, len(checked), BATCH):
            part = checked[k : k + BATCH]
            p = np.clip(forward(part)[-1], 1e-7, 1 - 1e-7)
            loss -= float(np.where(y[part] == 1, np.log(p), np.log(1 - p)).sum())
        since = 0 if loss < least or not len(checked) else since + 1
        if not since:
            best, least = [p.copy() for p in params], loss
        elif since == PATIENCE:
            break
    return Network(*best)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most SAMPLE_DOCS documents, a third of label 0 and two thirds of label 1 where there are enough, in an order that the ids decide.

    Only ids and labels are ordered.  The chosen documents are taken in that
    order, those passed over that are longer than what is left of SAMPLE_BYTES.
    Null ids and labels are left out, and an id that is labelled twice counts
    once, with label 0 if it has both.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.min("y").alias("y")).withColumn("order", F.xxhash64("id")).where(learn)
    chosen = [r for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy("order", "id").limit(SAMPLE_DOCS * (y + 1) // 3).collect()]
    if not chosen:
        return [], []
    def among(rows: list) -> DataFrame:  # at most SAMPLE_DOCS ids
        few = docs.sparkSession.createDataFrame([(r["id"], r["y"], r["order"]) for r in rows], "id long, y int, order long")
        return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")).join(F.broadcast(few), "id")

    # Sizes first, so that no more than the bound is fetched.
    kept, left = [], SAMPLE_BYTES
    for r in sorted(among(chosen).groupBy("id", "y", "order").agg(F.sum(F.octet_length("t")).alias("n")).collect(), key=lambda r: (r["order"], r["id"])):
        if r["n"] <= left:
            kept.append(r)
            left -= r["n"]
    got = sorted(among(kept).collect(), key=lambda r: (r["order"], r["t"]))
    return [bytes(r["t"]) for r in got], [r["y"] for r in got]


def score_quality(docs: DataFrame, net: Network, text_col: str = "text", output: str = "score") -> DataFrame:
    """docs with a double column `output`, the probability that a document's quality label is 1.

    Null texts score as empty ones.  All columns of docs are kept as they are,
    whatever their names; one named like the output is replaced.  Nothing is
    shuffled.
    """
    spark = docs.sparkSession
    rest = docs.drop(output)
    (text,) = fresh(docs, "__text")
    plain = docs.select(*(F.col(f"`{c}`") for c in rest.columns), F.col(text_col).cast("binary").alias(text))
    schema = rest.withColumn(output, F.lit(0.0)).schema
    sent = spark.sparkContext.broadcast(net)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            scores = [net.score(part) for _, part in chunks(column(b, text), PART)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=schema.names)

    return plain.mapInArrow(task(scored), schema)


def remainder(column_name: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column_name).cast("string")) % n


def quality_network(docs: DataFrame, labels: DataFrame) -> Network:
    """The network that learns from labels outside fold 0 of 5."""
    return fit(*labelled_sample(docs, labels, remainder("id", 5) != 0))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = quality_network(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score_quality(docs.select("doc_id", "text"), net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_quality": op1_quality}
