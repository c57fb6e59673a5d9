"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts up to ORDER bytes, counted over all
training documents.  A byte is coded in its longest known context; where it
didn't follow that context there, an escape is coded (method D: half a count for
each distinct byte) and the next shorter context is tried, in which the bytes
that followed the longer one are excluded; at the end stand the bytes never
seen, all alike.  A document's score is the sum over its bytes and one end
(byte 0); upper-case A-Z are lower-cased first, as for the base score.

With whole counts a context's followers are a subset of its suffix's, so what
must be excluded at a level is known from the level above: its mass is stored
with the context.  The trie is a table in parts by the last two bytes of the
context, so that all longer contexts with the same end are in one part, whole;
only the followers of contexts of no and one byte, 2**16 at most, travel.
Counts are added up in groups of tasks first, then for each part.  Documents are
taken in blocks; each part gets the distinct contexts and bytes of all blocks
that end so, and answers each block with their scores.  A part that very many
blocks ask is dealt to several tasks, each with the part's trie and some of the
blocks.  Nothing is dropped at any size and the trie is never in one place.

The base score needs the counts of all words in the same way:
distinct words of blocks and their counts travel as sorted hashes by slice of
the hash range, each slice adds them up and answers each block with the totals.
So neither vocabulary nor documents are ever in one place.  Words are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, written
from .textbytes import LOWER, SOLID, U, chunks, column, mixed, word_hashes
from .worker import give_back, task

ORDER = 5
#: Parts that add up contexts, at least, and bytes of text that one part more serves.
SLICES, SLICE_BYTES = 64, 16 << 20
#: Bytes of text of a block, and of what is worked on at a time.
BLOCK, CHUNK = 32 << 20, 1 << 18
#: Distinct contexts that a block holds in pieces before it takes them together.
LOOSE = 1_500_000
#: Compressed contexts that one task answers, and bytes of text whose counts are first added up apart.
ASKED_BYTES, APART = 64 << 20, 1 << 30
#: Symbols that are sorted together with their places.
PLACES = 1 << 16
#: Hash of the end token.
END = U(0x5DEECE66D1234567)
#: Symbols of bytes: lower case, and 255, which no text in UTF-8 has, for zero, which marks beginning and end.
SYMBOL = LOWER.copy()
SYMBOL[0] = 255


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and the end of each text: ORDER bytes before it and itself, as one number; and where each text begins."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    # Zeros of texts become another symbol; those put in between stay.
    data = np.zeros(int(first[-1]) + ORDER * len(texts), np.uint8)
    begin = first[:-1] + ORDER * np.arange(1, len(texts) + 1)
    text = SYMBOL[np.frombuffer(b"".join(texts), np.uint8)]
    data[np.arange(len(text)) + np.repeat(begin - (first[:-1] - np.arange(len(texts))), size - 1)] = text
    at = np.arange(first[-1]) + np.repeat(np.arange(len(texts)) * ORDER, size)
    key = np.zeros(max(0, len(data) - ORDER), U)
    for j in range(ORDER + 1):
        key = (key << U(8)) | data[j : len(data) - ORDER + j]
    return key[at], first


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, and the text each belongs to."""
    h, at = word_hashes(texts, SOLID)
    return np.insert(h, at[1:], END), np.repeat(np.arange(len(texts)), np.diff(at) + 1)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def looked_up(asked: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of contexts among ascending keys; they are sorted with their places, as sorted ones are found fast."""
    out = np.empty(len(asked))
    for k in range(0, len(asked), PLACES):
        part = asked[k : k + PLACES] << U(16) | np.arange(min(PLACES, len(asked) - k), dtype=U)
        part.sort()
        key = part >> U(16)
        new = np.append(True, key[1:] != key[:-1])
        out[k + (part & U(0xFFFF)).astype(np.int64)] = values[np.searchsorted(keys, key[new])][np.cumsum(new) - 1]
    return out


class Trie:
    """Tables of contexts and followers, ready to score."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[k]: followers of contexts of k bytes as ascending keys (context and byte), and their counts."""
        self.levels, self.stats = levels, []
        for k, (keys, counts) in enumerate(levels):
            ctx = keys >> U(8)
            start = np.flatnonzero(np.diff(ctx, prepend=~ctx[:1])) if len(ctx) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts, start) if len(start) else counts
            distinct = np.diff(np.append(start, len(keys)))
            shared = np.zeros(len(start), np.int64)
            if k and len(start):
                low_keys, low = levels[k - 1]
                shared = np.add.reduceat(low[np.searchsorted(low_keys, keys & U((1 << (8 * k)) - 1))], start)
            self.stats.append((ctx[start], total, distinct, shared))
        keys, counts = levels[-1]
        ctx, total = self.stats[-1][:2]
        logp = np.log10((2 * counts - 1) / (2 * total[np.searchsorted(ctx, keys >> U(8))])) if len(keys) else np.zeros(0)
        self.bits = max(4, int(len(keys) * 2).bit_length())
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.logp = keys[order], logp[order]
        self.start = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> U(64 - self.bits)).astype(np.int64)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each byte in its context."""
        out = np.zeros(len(keys))
        slot = self._slot(keys)
        at, end = self.start[slot], self.start[slot + 1]
        rest = np.arange(len(keys))
        missing = []
        while len(rest):
            live = at < end
            missing.append(rest[~live])
            rest, at, end = rest[live], at[live], end[live]
            hit = self.keys[at] == keys[rest]
            out[rest[hit]] = self.logp[at[hit]]
            rest, at, end = rest[~hit], at[~hit] + 1, end[~hit]
        miss = np.concatenate(missing) if missing else rest
        if len(miss):
            distinct, back = np.unique(keys[miss], return_inverse=True)
            out[miss] = self._escaped(distinct)[back]
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        rest = np.arange(len(keys))
        mass, number = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # excluded
        for k in range(len(self.levels) - 1, -1, -1):
            key = keys[rest] & U((1 << (8 * (k + 1))) - 1)
            ctx, total, distinct, shared = self.stats[k]
            followers, counts = self.levels[k]
            if not len(ctx):
                continue
            c = np.minimum(np.searchsorted(ctx, key >> U(8)), len(ctx) - 1)
            known = ctx[c] == key >> U(8)
            f = np.minimum(np.searchsorted(followers, key), len(followers) - 1)
            hit = known & (followers[f] == key) if len(followers) else np.zeros(len(key), bool)
            left = total[c] - mass
            out[rest[hit]] += np.log10((2 * counts[f[hit]] - 1) / (2 * left[hit]))
            escape = known & ~hit & (left > 0)
            out[rest[escape]] += np.log10((distinct[c[escape]] - number[escape]) / (2 * left[escape]))
            # Of an unknown context nothing is excluded below; of a known one its followers.
            mass, number = np.where(known, shared[c], 0), np.where(known, distinct[c], 0)
            rest, mass, number = rest[~hit], mass[~hit], number[~hit]
        out[rest] -= np.log10(256 - number)
        return out


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _packed(data: bytes) -> bytes:
    """Compressed bytes after their number: what blocks and parts send each other is larger than the texts."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending contexts and bytes, byte by byte of all of them."""
    return _packed(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ORDER + 1].T.tobytes())


def _unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacked(data), np.uint8).reshape(ORDER + 1, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : ORDER + 1] = planes.T
    return out.view("<u8").ravel()


def part_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """The part of the trie that each context and byte belongs to: by the last two bytes before."""
    return (mixed((keys >> U(8)) & U(0xFFFF)) % U(slices)).astype(np.int64)


def trie_table(docs: DataFrame, text_col: str = "text", slices: int = SLICES, groups: int = 1) -> DataFrame:
    """part, level, keys, counts for the whole trie of all texts of docs: followers of contexts of `level` bytes; those of one byte are sums of the part only."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() % groups
        keys, counts, size = [], [], 0
        for b in batches:
            for _, run in chunks(column(b, "__text"), CHUNK):
                k, c = np.unique(contexts(run)[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                size += len(k)
                if size > 1_000_000:
                    k, c = added(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, size = [k], [c], len(k) // 2
        if keys:
            k, c = added(np.concatenate(keys), np.concatenate(counts))
            part = part_of(k, slices)
            order = np.argsort(part, kind="stable")
            k, c, cut = k[order], c[order], np.searchsorted(part[order], np.arange(slices + 1))
            yield pa.RecordBatch.from_arrays([pa.array([number] * slices, pa.int32()), pa.array(range(slices), pa.int32()), pa.array([_blob(k[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([_blob(c[a:b].astype(np.int64)) for a, b in zip(cut, cut[1:])], pa.binary())], names=["task", "part", "keys", "counts"])

    def added_up(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return added(*(np.concatenate([np.frombuffer(x, t) for x in table[n].to_pylist()]) for n, t in (("keys", U), ("counts", np.int64))))

    def grouped(table: pa.Table) -> pa.Table:
        k, c = added_up(table)
        return pa.table({"part": table["part"][:1], "keys": pa.array([_blob(k)], pa.binary()), "counts": pa.array([_blob(c)], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        """Followers of contexts of 1 to ORDER bytes; all of a context of two bytes are in one part."""
        k, c = added_up(table)
        rows = [(ORDER, k, c)]
        for level in range(ORDER - 1, 0, -1):
            k, c = added(k & U((1 << (8 * (level + 1))) - 1), c)
            rows.append((level, k, c))
        return pa.table({"part": pa.array([table["part"][0].as_py()] * len(rows), pa.int32()), "level": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([_blob(r[1]) for r in rows], pa.binary()), "counts": pa.array([_blob(r[2]) for r in rows], pa.binary())})

    parts = docs.select(F.col(text_col).cast("binary").alias("__text")).mapInArrow(task(counted), "task int, part int, keys binary, counts binary")
    if groups > 1:
        parts = parts.groupBy("task", "part").applyInArrow(grouped, "part int, keys binary, counts binary")
    return written(parts.groupBy("part").applyInArrow(summed, "part int, level int, keys binary, counts binary"), "trie")


def shortest(parts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Followers of contexts of no and one byte in the whole trie: 2**16 at most."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(column(b, "keys"), column(b, "counts")):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, U).astype(np.int32)), pa.array(np.frombuffer(c, np.int64))], names=["key", "n"])

    rows = parts.where("level = 1").select("keys", "counts").mapInArrow(task(opened), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    one = added(np.array([r["key"] for r in rows], U), np.array([r["n"] for r in rows], np.int64))
    return [added(one[0] & U(0xFF), one[1]), one]


def score_documents(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score for each row of docs; learn tells which rows are training documents.

    Null texts are empty ones: one end token.  Repeated rows count each; ids may
    be null.  If nothing is learned from, words have probability 1 each by the
    base formula and bytes 1/256.  Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("binary").alias("__text"))
    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    slices = max(SLICES, size // SLICE_BYTES)
    parts = trie_table(rows.where("learn"), "__text", slices, max(1, math.isqrt(size // APART)))
    sent = spark.sparkContext.broadcast(shortest(parts))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        ids, learned, kept, words, seen, keys, size, loose = [], [], [], [], [], [], 0, 0

        def made() -> pa.RecordBatch:
            word, n = added(np.concatenate(words), np.concatenate(seen))
            word_cut = np.searchsorted(((word >> U(32)) * U(slices)) >> U(32), np.arange(slices + 1, dtype=U))
            key, key_cut = dealt(np.unique(np.concatenate(keys)))
            full, ends = np.flatnonzero(np.diff(word_cut)).tolist(), np.flatnonzero(np.diff(key_cut)).tolist()
            out = {"block": [(task << 32) + nth] * (1 + len(full) + len(ends)), "slice": [-1, *full, *[None] * len(ends)], "part": [None] * (1 + len(full)) + ends}
            out["keys"] = [None, *(_blob(word[word_cut[x] : word_cut[x + 1]]) for x in full), *(_packed_keys(key[key_cut[x] : key_cut[x + 1]]) for x in ends)]
            out["seen"] = [None, *(_packed(_blob(n[word_cut[x] : word_cut[x + 1]].astype("<u4"))) for x in full), *[None] * len(ends)]
            out |= {c: [v, *[None] * (len(full) + len(ends))] for c, v in (("ids", ids), ("learned", learned), ("lengths", list(map(len, kept))), ("texts", _packed(b"".join(kept))))}
            types = {"block": pa.int64(), "slice": pa.int32(), "part": pa.int32(), "keys": pa.binary(), "seen": pa.binary(), "ids": pa.list_(pa.int64()), "learned": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int64()), "texts": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in types.items()], names=list(types))

        for b in batches:
            got_ids, got_learn, texts = column(b, "id"), column(b, "learn"), column(b, "__text")
            for i, run in chunks(texts, CHUNK):
                key = contexts(run)[0]
                keys.append(np.unique(key))
                loose += len(keys[-1])
                if loose > LOOSE:
                    keys = [np.unique(np.concatenate(keys))]
                    loose = len(keys[0]) // 2
                h, owner = tokens(run)
                word, back = np.unique(h, return_inverse=True)
                words.append(word)
                seen.append(np.bincount(back, np.array(got_learn[i : i + len(run)])[owner], len(word)).astype(np.int64))
                ids += got_ids[i : i + len(run)]
                learned += got_learn[i : i + len(run)]
                kept += run
                size += len(key)
                if size >= BLOCK:
                    yield made()
                    give_back()
                    ids, learned, kept, words, seen, keys, size, loose, nth = [], [], [], [], [], [], 0, 0, nth + 1
        if ids:
            yield made()

    def dealt(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts and bytes by part of the trie, and where each part begins (one entry more: their number)."""
        part = part_of(keys, slices)
        order = np.argsort(part, kind="stable")
        return keys[order], np.searchsorted(part[order], np.arange(slices + 1))

    schema = "block long, slice int, part int, keys binary, seen binary, ids array<long>, learned array<boolean>, lengths array<long>, texts binary"
    blocks = written(rows.mapInArrow(task(blocked), schema), "word-blocks")

    def scored(table: pa.Table) -> pa.Table:
        """The scores of each block's contexts and bytes that belong to a part of the trie."""
        held = {level: (np.frombuffer(k, U), np.frombuffer(c, np.int64)) for level, k, c in zip(*(table[c].to_pylist() for c in ("level", "keys", "counts"))) if level is not None and level > 1}
        none = np.zeros(0, U), np.zeros(0, np.int64)
        trie = Trie([*sent.value, *(held.get(level, none) for level in range(2, ORDER + 1))])
        asked = [(block, k) for block, k in zip(table["block"].to_pylist(), table["keys"].to_pylist()) if block is not None]
        scores = [_packed(_blob(trie.score(_unpacked_keys(k)).astype(np.float32))) for _, k in asked]
        return pa.table({"block": pa.array([block for block, _ in asked], pa.int64()), "part": pa.array([table["part"][0].as_py()] * len(asked), pa.int32()), "scores": pa.array(scores, pa.binary())})

    # A part that is asked much is dealt to several tasks, by block.
    salts = blocks.where("part is not null").groupBy("part").agg(F.ceil(F.sum(F.octet_length("keys")) / ASKED_BYTES).cast("int").alias("salts"))
    salts = written(salts, "asked-parts").withColumnRenamed("part", "p")
    asked = blocks.where("part is not null").join(salts, F.col("part") == F.col("p")).select("part", F.pmod(F.col("block"), F.col("salts")).cast("int").alias("salt"), F.lit(None).cast("int").alias("level"), "keys", F.lit(None).cast("binary").alias("counts"), "block")
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    known = parts.where("level > 1").join(salts, F.col("part") == F.col("p")).select("part", every, "level", "keys", "counts", F.lit(None).cast("long").alias("block"))
    scores = written(asked.unionByName(known).groupBy("part", "salt").applyInArrow(scored, "block long, part int, scores binary"), "context-scores")
    dropped(spark, parts)

    def totals(table: pa.Table) -> pa.Table:
        """The counts over all blocks of each block's words, and in a row of block -1 the sums of the slice."""
        keys = [np.frombuffer(k, U) for k in table["keys"].to_pylist()]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, np.concatenate([np.frombuffer(_unpacked(c), "<u4") for c in table["seen"].to_pylist()]), len(distinct)).astype(np.int64)
        parts = np.split(total[back], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"block": pa.array([*table["block"].to_pylist(), -1], pa.int64()), "slice": pa.array([*table["slice"].to_pylist(), -1], pa.int32()), "counts": pa.array([*(_packed(_blob(p)) for p in parts), None], pa.binary()), "tokens": pa.array([None] * len(keys) + [int(total.sum())], pa.int64()), "distinct": pa.array([None] * len(keys) + [int((total > 0).sum())], pa.int64())})

    answers = written(blocks.where("slice >= 0").select("block", "slice", "keys", "seen").groupBy("slice").applyInArrow(totals, "block long, slice int, counts binary, tokens long, distinct long"), "word-counts")
    n_tokens, n_distinct = (v or 0 for v in answers.agg(F.sum("tokens"), F.sum("distinct")).first())

    def finished(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        mine = next(r for r in rows if r["ids"] is not None)
        c = np.concatenate([np.frombuffer(_unpacked(r["counts"]), np.int64) for r in sorted((r for r in rows if r["counts"] is not None), key=lambda r: r["slice"])])
        logp = np.concatenate([np.zeros(0)] + [np.frombuffer(_unpacked(r["scores"]), np.float32) for r in sorted((r for r in rows if r["scores"] is not None), key=lambda r: r["part"])])
        texts, at = _unpacked(mine["texts"]), np.concatenate(([0], np.cumsum(mine["lengths"]))).tolist()
        runs = [run for _, run in chunks([texts[a:b] for a, b in zip(at, at[1:])], CHUNK)]
        word = np.unique(np.concatenate([np.unique(tokens(run)[0]) for run in runs]))
        key = np.unique(np.concatenate([np.unique(contexts(run)[0]) for run in runs]))
        logp = logp[np.argsort(np.argsort(part_of(key, slices), kind="stable"), kind="stable")]  # back from the order of parts
        n, base, known, score = [], [], [], []
        for run in runs:
            h, owner = tokens(run)
            some, back = np.unique(h, return_inverse=True)
            total = c[np.searchsorted(word, some)]
            n.append(np.bincount(owner, minlength=len(run)))
            base.append(np.bincount(owner, np.log10(total + 1.0)[back], len(run)))
            known.append(np.bincount(owner, (total > 0)[back], len(run)))
            each, first = contexts(run)
            score.append(np.add.reduceat(looked_up(each, key, logp), first[:-1]))
        n = np.concatenate(n).astype(np.int64)
        base = np.concatenate(base) - n * np.log10(n_tokens + n_distinct + 1.0)
        return pa.table({"doc_id": pa.array(mine["ids"], pa.int64()), "learned": pa.array(mine["learned"], pa.bool_()), "n_tokens": n, "n_known": np.concatenate(known).astype(np.int64), "train_tokens": pa.array([n_tokens] * len(n), pa.int64()), "base_score": base, "score": np.concatenate(score)})

    none = F.lit(None)
    both = blocks.where("slice = -1").select("block", none.cast("int").alias("slice"), none.cast("int").alias("part"), "ids", "learned", "lengths", "texts", none.cast("binary").alias("counts"), none.cast("binary").alias("scores"))
    both = both.unionByName(answers.where("block >= 0").select("block", "slice", "counts"), allowMissingColumns=True).unionByName(scores, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(finished, "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 7
    return score_documents(docs, remainder != 2).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op3_ppm": op3_ppm}
