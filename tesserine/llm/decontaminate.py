"""Benchmark decontamination by Wu-Manber multi-pattern search.

The windows of the benchmark items are the patterns.  Texts and patterns are
normalised to lower-cased words between single spaces.  A shift table over
hashed byte blocks tells how far a search position may jump; where the shift is
zero, the block's bucket holds the only patterns that can end there, the first
block selects among them, and the bytes of those that are left are compared.  Many stretches of text are searched in step, so that each
table lookup serves thousands of positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written
from .textbytes import LOWER, U, WORD, chunks, column, joined, mixed, span_hashes, spans
from .worker import fresh, task

#: Words of a window.
WINDOW = 10
#: Bytes of a block; shorter where the shortest pattern of a class is shorter.
BLOCK = 8
#: Bits of a shift table, at most.
TABLE_BITS = 20
#: Benchmark text that one pass over the documents takes, whose tables take about six times that; a larger benchmark takes more passes.
PASS_BYTES = 16 << 20
#: Bytes of text searched at a time, and stretches searched in step.
CHUNK, LANES = 1 << 20, 2048


def normalised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as " w1 w2 ... wn ", each after a line feed, in one array; where each text begins in it (one entry more); the count of words of each."""
    data, at = joined(texts)
    data = LOWER[data]
    word = WORD[data]
    starts, ends = spans(word)
    first = np.searchsorted(starts, at)
    counts = np.diff(first)
    sizes = np.zeros(len(texts) + 1, np.int64)  # line feed, space, and each word with a space
    before = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=before[1:])
    np.cumsum(before[first[1:]] - before[first[:-1]] + counts + 2, out=sizes[1:])
    # Word bytes move to: 2 bytes for each text up to here, and a space after each word before.
    out = np.full(sizes[-1], 32, np.uint8)
    out[sizes[:-1]] = 10
    owner = np.repeat(np.arange(len(texts)), counts)
    to = before[:-1] + np.arange(len(starts)) + 2 * (owner + 1)
    out[np.repeat(to - before[:-1], ends - starts) + np.arange(before[-1])] = data[word]
    return out, sizes, counts


class Searcher:
    """Shift and bucket tables for patterns of about one length: the stretches start to end of a text in bytes."""

    def __init__(self, text: bytes, start: np.ndarray, end: np.ndarray, owner: np.ndarray):
        self.text = text
        self.shortest = m = int((end - start).min())
        self.block = min(BLOCK, m)
        self.bits = max(12, min(TABLE_BITS, (4 * m * len(start)).bit_length()))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int32)
        words = self.words(np.frombuffer(text + bytes(8), np.uint8))
        for last in range(self.block, m + 1):  # ever smaller shifts, so that the smallest stays
            self.shift[self.slot(words[start + last - self.block])] = m - last
        key = self.key(words[start + m - self.block], words[start])
        order = np.argsort(key, kind="stable")
        self.bucket, self.start, self.end, self.owner = key[order], start[order], end[order], owner[order]

    def words(self, data: np.ndarray) -> np.ndarray:
        """The block of bytes at each place of data as a number; data has 8 bytes more at its end."""
        return np.ndarray(shape=(len(data) - 8,), dtype="<u8", buffer=data, strides=(1,)) & U((1 << (8 * self.block)) - 1)

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (mixed(blocks) >> U(64 - self.bits)).astype(np.int64)

    @staticmethod
    def key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Of a bucket, which is told by the suffix, the patterns with a prefix."""
        return mixed(suffix) + prefix * U(0x9E3779B97F4A7C15)

    def find(self, data: np.ndarray, raw: bytes) -> Iterator[tuple[int, int]]:
        """(start, pattern) of each occurrence; data has 8 bytes more than raw at its end."""
        m, n = self.shortest, len(raw)
        if n < m:
            return
        words = self.words(data)
        bounds = np.linspace(m - self.block, n - self.block + 1, min(LANES, n - m + 1) + 1).astype(np.int64)
        at, end = bounds[:-1].copy(), bounds[1:]
        stops = []
        while len(at):
            step = self.shift[self.slot(words[at])]
            stops.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]
        at = np.concatenate(stops)
        start = at + self.block - m
        key = self.key(words[at], words[start])
        low, high = np.searchsorted(self.bucket, key), np.searchsorted(self.bucket, key, "right")
        for i in np.flatnonzero(low < high).tolist():
            for k in range(low[i], high[i]):
                if raw.startswith(self.text[self.start[k] : self.end[k]], start[i]):
                    yield int(start[i]), k


class Benchmark:
    """The windows of items: size consecutive words, or all of an item's if there are fewer, none if there is none."""

    def __init__(self, items: list[bytes | None], size: int = WINDOW):
        data, _, counts = normalised([t or b"" for t in items])
        spaces = np.flatnonzero(data == 32)
        spaces_before = np.cumsum(counts + 1) - counts - 1
        n = np.where(counts, np.maximum(counts - size + 1, 1), 0)  # windows of each item
        item = np.repeat(np.arange(len(items)), n)
        first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + spaces_before[item]
        words = np.minimum(counts, size)[item]
        start, end = spaces[first], spaces[first + words] + 1
        # Equal windows are one pattern with several items.
        h = span_hashes(data, start, end)
        order = np.argsort(h, kind="stable")
        new = np.flatnonzero(np.diff(h[order], prepend=~h[order][:1])) if len(h) else np.zeros(0, np.int64)
        self.items, self.items_from = item[order].astype(np.int32), np.append(new, len(h))
        start, end = start[order][new], end[order][new]
        self.words = words[order][new].astype(np.int32)
        # A searcher for each class of pattern lengths, so that a few short items don't shorten all jumps.
        size_class = np.floor(2 * np.log2(np.maximum(end - start, 1))).astype(np.int64)
        text = data.tobytes()
        self.searchers = [Searcher(text, start[mine], end[mine], np.flatnonzero(mine)) for mine in (size_class == c for c in np.unique(size_class))]

    def find(self, data: np.ndarray, raw: bytes) -> Iterator[tuple[int, int, list[int]]]:
        """(start, words, items) of each occurrence of a window."""
        for s in self.searchers:
            for start, k in s.find(data, raw):
                w = s.owner[k]
                yield start, int(self.words[w]), self.items[self.items_from[w] : self.items_from[w + 1]].tolist()


def hits(texts: list[bytes | None], benchmark: Benchmark) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: count of words, runs of hit words as (first, count), items found."""
    for _, run in chunks(texts, CHUNK):
        data, at, counts = normalised(run)
        raw = data.tobytes()
        data = np.concatenate((data, np.zeros(8, np.uint8)))
        found: dict[int, tuple[set, set]] = {}
        spaces = np.flatnonzero(data == 32)
        begins = np.searchsorted(spaces, at)
        for start, words, items in benchmark.find(data, raw):
            i = int(np.searchsorted(at, start, "right")) - 1
            runs, who = found.setdefault(i, (set(), set()))
            runs.add((int(np.searchsorted(spaces, start) - begins[i]), words))
            who.update(items)
        for i, n in enumerate(counts.tolist()):
            runs, who = found.get(i, ((), ()))
            yield n, sorted(runs), sorted(who)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs joined where they touch or overlap."""
    out: list[list[int]] = []
    for first, n in sorted(runs):
        if out and first <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], first + n - out[-1][0])
        else:
            out.append([first, n])
    return [tuple(r) for r in out]


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, keep: tuple[str, ...] = (), outputs: tuple[str, str, str] = ("n_words", "runs", "items")) -> DataFrame:
    """Columns id_col, keep, n_words, runs (hit words as array of (first, count)) and items (ids as sorted strings) for each row of docs; outputs may name the last three otherwise.

    The benchmark is read in passes of at most PASS_BYTES of text, each sent to
    the executors; so its size has no limit, and what is sent has one.  Each pass
    adds to the runs and items of its rows, without a shuffle.
    Null texts have no words; items with a null id or without words match
    nothing; repeated items count once, rows of docs that are repeated each.  Of
    columns to keep, one named like an output gives way to it; other names of
    docs' columns don't matter.
    """
    spark = docs.sparkSession
    n_words, runs_name, items_name = outputs
    rest = [c for c in dict.fromkeys((id_col, *keep)) if c.lower() not in {o.lower() for o in outputs}]
    (text,) = fresh(docs, "__text")
    kept = [F.col(f"`{c}`") for c in rest]
    out = docs.select(*kept, F.col(text_col).cast("binary").alias(text), F.lit(None).cast("array<struct<first:long,count:long>>").alias(runs_name), F.lit(None).cast("array<string>").alias(items_name))
    schema = out.select(*kept, text, F.lit(0).cast("long").alias(n_words), runs_name, items_name).schema

    def passes() -> Iterator[list[tuple[str, bytes]]]:
        got, n = [], 0
        for r in items.select(F.col(item_id).cast("string"), F.col(item_text).cast("binary")).where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).toLocalIterator():
            if got and n + len(r[1]) > PASS_BYTES:
                yield got
                got, n = [], 0
            got.append((r[0], bytes(r[1])))
            n += len(r[1])
        yield got

    def one(these: list[tuple[str, bytes]]):
        sent = spark.sparkContext.broadcast((Benchmark([t for _, t in these], size), [i for i, _ in these]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            benchmark, names = sent.value
            for b in batches:
                runs, who, counts = column(b, runs_name), column(b, items_name), []
                for i, (n, r, w) in enumerate(hits(column(b, text), benchmark)):
                    counts.append(n)
                    runs[i] = [{"first": f, "count": c} for f, c in merged([(x["first"], x["count"]) for x in runs[i] or ()] + r)]
                    who[i] = sorted({*(who[i] or ()), *(names[k] for k in w)})
                place = b.schema.get_field_index
                arrays = [*(b.column(place(c)) for c in (*rest, text)), pa.array(counts, pa.int64()), pa.array(runs, b.schema.field(runs_name).type), pa.array(who, b.schema.field(items_name).type)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, text, *outputs])

        return task(search)

    for k, these in enumerate(passes()):
        if k:  # the tables of one pass at a time in an executor's memory
            out = written(out, "decontaminate")
        out = out.mapInArrow(one(these), schema)
    return out.drop(text)


def n_hit(runs: F.Column) -> F.Column:
    """Hit words; the runs of find_items don't overlap."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["count"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", n_hit(F.col("runs")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def _oracle(size: int = WINDOW) -> str:
    """Windows of items and runs of as many words of documents, joined as strings."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
 grams AS (SELECT DISTINCT item_id, least(len(w), {size}) AS n, array_to_string(w[i:i + least(len(w), {size}) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {size} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 runs AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
 hits AS (SELECT doc_id, i, runs.n, item_id FROM runs JOIN grams USING (n, g)),
 covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
 found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES = {"op2_decontamination": _oracle()}
