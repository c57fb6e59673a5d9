"""Spelling variant grouping: words one edit apart, found through Bloom filters of the vocabulary.

A word is a row of bytes, one for each code point (all are below U+0100).  Its
hash is a sum of one random number for each place and byte, so the hash of an
edited word takes one subtraction and one addition.  Every filter is a blocked
Bloom filter: a word sets five bits of one 64-bit block.  Filters are sharded by
the length of their words; a shard over PASS_BYTES is divided by the hash of one
half of the word, which an edit in the other half leaves alone, so each edit is
generated once and probed in one shard.  Shards are sent in passes of at most
PASS_BYTES.  Only edits that the filter doesn't rule out leave their task; an
exact join with the vocabulary decides on them.

A pair of words is looked for from one side: the longer word deletes, of two
words of one length the one with the smaller code point replaces.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, written
from .textbytes import U, column, mixed
from .worker import fresh, task

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Every word loses a code point where this divides the hash of document and word (op11's damage).
DAMAGED = 31
#: Filter bits for each word, bits that a word sets, bytes of filters that are sent at a time, and blocks of a slice that one task builds.
BITS, HASHES, PASS_BYTES, SLICE = 24, 5, 32 << 20, 1 << 13
#: Words counted in a task before their counts are passed on, and edits that are hashed at a time.
COUNTED, EDITS = 1 << 17, 1 << 18
#: Words of a batch.
WORDS = 1 << 15

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_PLACES = 64


def _place(j: int) -> np.ndarray:
    """The random numbers of the 256 bytes at place j."""
    if j < _PLACES:
        return _TABLE[j]
    return mixed(np.arange(256, dtype=U) + U(256) * U(j))


_TABLE = mixed(np.arange(_PLACES * 256, dtype=U)).reshape(_PLACES, 256)


def damaged(run: str, prefix: int) -> str:
    """The run without one code point where DAMAGED divides the CRC-32 of `<doc_id>:<run>`; prefix: that of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), prefix)
    return run if h % DAMAGED else run[: h % len(run)] + run[h % len(run) + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all whole texts, each task's counts summed before they are shuffled. Null texts have no words; a null id counts as an empty one."""
    picked = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("t"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(column(b, "id"), column(b, "t")):
                if t:
                    prefix = zlib.crc32(f"{i}:".encode())
                    for run, n in Counter(_RUN.findall(t.lower().decode("utf-8", "replace"))).items():
                        word = damaged(run, prefix)
                        if len(word) >= LEAST_LENGTH:
                            found[word] += n
                    if len(found) > COUNTED:
                        yield taken()
                        found.clear()
        yield taken()

    counts = picked.mapInArrow(task(counted), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, places in the list, bytes (a row a word) of the words of each length."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        where = np.flatnonzero(sizes == size)
        joined = "".join([words[k] for k in where]).encode("latin-1")
        yield int(size), where, np.frombuffer(joined, np.uint8).reshape(-1, size)


def _terms(codes: np.ndarray, shift: int = 0) -> np.ndarray:
    """The random number of each byte at its place less shift."""
    out = np.zeros(codes.shape, U)
    for j in range(shift, codes.shape[1]):
        out[:, j] = _place(j - shift)[codes[:, j]]
    return out


def _part(total: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(total ^ U(0xA5A5A5A5)) >> U(32)) % U(parts)


def _bits(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), U)
    for k in range(HASHES):
        out |= U(1) << (h >> U(6 * k) & U(63))
    return out


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> U(32)) * U(blocks) >> U(32)).astype(np.int64)


class Shard:
    """The words of one length, or those of them whose half (0 left, 1 right) hashes to a part.

    blocks is the size of the filter, known from the number of words.
    """

    def __init__(self, size: int, words: int, half: int | None = None, part: int = 0, parts: int = 1):
        self.size, self.half, self.part, self.parts = size, half, part, parts
        self.blocks = max(1, -(-words * BITS // 64 // parts))

    @property
    def edits(self) -> tuple[int, int]:
        """First place and end of the places that may be edited."""
        middle = self.size // 2
        return {None: (0, self.size), 0: (middle, self.size), 1: (0, middle)}[self.half]

    def holds(self, terms: np.ndarray) -> np.ndarray:
        """Whether words of the shard's length belong to it."""
        return self._in(terms[:, : self.size // 2] if self.half == 0 else terms[:, self.size // 2 :])

    def holds_after(self, terms: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """The same of words that are one byte longer, after a deletion in the other half; moved: their terms a place further left."""
        return self._in(terms[:, : self.size // 2] if self.half == 0 else moved[:, self.size // 2 + 1 :])

    def _in(self, terms: np.ndarray) -> np.ndarray:
        return np.ones(len(terms), bool) if self.half is None else _part(terms.sum(axis=1, dtype=U), self.parts) == self.part


def passes(sizes: dict[int, int], most: int) -> list[list[Shard]]:
    """Shards for the number of words of each length, in groups whose filters take at most `most` bytes."""
    shards = []
    for size, words in sorted(sizes.items()):
        parts = max(1, -(-words * BITS // 8 // most))
        shards += [Shard(size, words)] if parts == 1 else [Shard(size, words, half, k, parts) for half in (0, 1) for k in range(parts)]
    out: list[list[Shard]] = []
    room = 0
    for s in shards:
        if s.blocks * 8 > room or not out:
            out.append([])
            room = most
        out[-1].append(s)
        room -= s.blocks * 8
    return out


def _filters(words: DataFrame, shards: list[Shard]) -> list[np.ndarray]:
    """The filters of the shards, built in slices of SLICE blocks; their size is bounded by the pass."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, _, codes in _by_length(column(b, "word")):
                terms = _terms(codes)
                h = mixed(terms.sum(axis=1, dtype=U))
                for k, s in enumerate(shards):
                    if s.size == size:
                        own = h[s.holds(terms)]
                        at = _block(own, s.blocks)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k), pa.int32()), pa.array(at // SLICE, pa.int32()), pa.array(at % SLICE, pa.int32()), pa.array(_bits(own).view(np.int64))], names=["shard", "slice", "at", "bits"])

    def built(key: tuple, rows: pa.Table) -> pa.Table:
        blocks = np.zeros(SLICE, U)
        np.bitwise_or.at(blocks, rows["at"].to_numpy(), rows["bits"].to_numpy().view(U))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "slice": pa.array([key[1].as_py()], pa.int32()), "blocks": pa.array([blocks.tobytes()], pa.binary())})

    keys = words.where(F.length("word").isin(sorted({s.size for s in shards}))).mapInArrow(task(placed, rows=WORDS), "shard int, slice int, at int, bits long")
    slices = keys.groupBy("shard", "slice").applyInArrow(built, "shard int, slice int, blocks binary").toArrow().to_pylist()
    out = [np.zeros(-(-s.blocks // SLICE) * SLICE, U) for s in shards]
    for r in slices:
        out[r["shard"]][r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["blocks"], U)
    return [f[: s.blocks].copy() for f, s in zip(out, shards)]


def _passing(h: np.ndarray, shard: Shard, blocks: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter doesn't rule out; the first bit rules out most."""
    h = mixed(h)
    found = blocks[_block(h, shard.blocks)]
    left = np.flatnonzero(found >> (h & U(63)) & U(1))
    want = _bits(h[left])
    return left[found[left] & want == want]


def candidates(codes: np.ndarray, shard: Shard, blocks: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """places of words, edited words (a row each) that the shard's filter lets pass, of words of the shard's length or one more."""
    terms = _terms(codes)
    first, end = shard.edits
    if codes.shape[1] == shard.size:
        own = np.flatnonzero(shard.holds(terms))
        codes, terms = codes[own], terms[own]
        total = terms.sum(axis=1, dtype=U)
        rows = max(1, EDITS // len(letters))
        for j in range(first, end):
            for k in range(0, len(codes), rows):
                old = codes[k : k + rows, j]
                word, letter = np.nonzero(old[:, None] < letters)
                h = (total[k : k + rows] - terms[k : k + rows, j])[word] + _place(j)[letters][letter]
                hit = _passing(h, shard, blocks)
                edited = codes[k + word[hit]].copy()
                edited[:, j] = letters[letter[hit]]
                yield own[k + word[hit]], edited
    else:
        moved = _terms(codes, 1)
        own = np.flatnonzero(shard.holds_after(terms, moved))
        codes, terms, moved = codes[own], terms[own], moved[own]
        end += end == shard.size  # the last place of the longer word
        for j in range(first, end):
            at = np.arange(len(codes)) if j == 0 else np.flatnonzero(codes[:, j] != codes[:, j - 1])
            h = terms[at, :j].sum(axis=1, dtype=U) + moved[at, j + 1 :].sum(axis=1, dtype=U)
            hit = at[_passing(h, shard, blocks)]
            yield own[hit], np.delete(codes[hit], j, axis=1)


def _probed(words: DataFrame, shards: list[Shard], letters: np.ndarray) -> DataFrame:
    """word, n, other: words with the edits that the filters of a pass let pass."""
    sent = words.sparkSession.sparkContext.broadcast((shards, _filters(words, shards), letters))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, filters, letters = sent.value
        for b in batches:
            for size, where, codes in _by_length(column(b, "word")):
                for s, f in zip(shards, filters):
                    if size - s.size in (0, 1):
                        for own, edited in candidates(codes, s, f, letters):
                            at = pa.array(where[own])
                            others = [r.tobytes().decode("latin-1") for r in edited]
                            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(others, pa.string())], names=["word", "n", "other"])

    sizes = sorted({s.size + k for s in shards for k in (0, 1)})
    return words.where(F.length("word").isin(sizes)).select("word", "n").mapInArrow(task(probed, rows=WORDS), "word string, n long, other string")


def near_pairs(words: DataFrame, most: int = PASS_BYTES) -> DataFrame:
    """word, n, other, other_n: each pair of words (columns word and n, each word once, code points below U+0100) that differ by exactly one inserted, deleted or replaced code point, once.

    Several lengths of the vocabulary go in one pass; what a pass sends is
    bounded by `most` bytes, and passes follow one another.
    """
    sizes = {r["size"]: r["words"] for r in words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("words")).collect()}
    letters = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").distinct().collect()), np.uint8)
    found = [_probed(words, shards, letters) for shards in passes(sizes, most)]
    if not found:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).where(F.lit(False))
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return every.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for words with a form: forms are followed twice as far each time. A form is at least RATIO times as frequent as its word, so chains are short."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(forms.sparkSession, now)
        now = moved
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(words: DataFrame, most: int = PASS_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n, root for each of the words (columns word and n).

    form: of the words one edit away the most frequent (ties: the first in
    code-point order), where it is at least RATIO times as frequent; root: the
    last of the chain of forms, the word itself where it has none.
    """
    spark = words.sparkSession
    pairs = written(near_pairs(words, most), "near-words")
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("own_n"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    is_form = -F.col("best.m") >= RATIO * F.col("own_n")
    near = written(best.select("word", "n_near", F.when(is_form, F.col("best.w")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "near-counts")
    dropped(spark, pairs)
    roots = _roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = PASS_BYTES) -> DataFrame:
    """The variants of all words of docs; see vocabulary and variants.

    Repeated rows count each time.  Words of any length are taken.  An empty
    table gives an empty result; columns other than id and text aren't read,
    whatever their names.
    """
    return variants(written(vocabulary(docs, id_col, text_col), "vocabulary"), most)


def with_roots(docs: DataFrame, groups: DataFrame, text_col: str = "text", output: str = "roots") -> DataFrame:
    """docs with a column `output`, a map from the words of the text (lower-cased A-Z, as in groups) to the roots that differ from them; null for null texts."""
    row, word, root = fresh(docs, "__row", "__word", "__root")
    lowered = F.translate(F.col(f"`{text_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"([a-zÀ-ÿ]{{{LEAST_LENGTH},}})"), 1))
    numbered = written(docs.drop(output).withColumn(row, F.monotonically_increasing_id()), "spelled")
    changed = groups.where("word != root").select(F.col("word").alias(word), F.col("root").alias(root))
    pairs = numbered.select(row, F.explode(found).alias(word)).join(changed, word).groupBy(row).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(word, root)))).alias(output))
    kept = numbered.join(pairs, row, "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return kept.withColumn(output, F.when(F.col(f"`{text_col}`").isNotNull(), F.coalesce(F.col(output), empty))).drop(row)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word", "form", "root", "n", "n_near", "form_n")


def _oracle() -> str:
    """Pairs that share a word with one code point left out at the same place, or of which one is the other with one left out."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    crc = f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"
    ctes = [
        "runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)",
        "counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL)",
        f"hashed AS (SELECT run, n, {crc} AS h FROM counted)",
        "words AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7)",
        "cut AS (SELECT word, n, p, word[1:p] || word[p + 2:] AS rest FROM words, unnest(range(length(word))) AS places(p))",
        "pairs AS (SELECT a.word AS w, a.n AS n, b.word AS o, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word AND length(a.word) = length(b.word)"
        " UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest)",
        "best AS (SELECT w AS word, n, count(*) AS n_near, min({'m': -m, 'o': o}) AS b FROM pairs GROUP BY w, n)",
        "near AS (SELECT word, n_near, CASE WHEN -b.m >= 10 * n THEN b.o END AS form, CASE WHEN -b.m >= 10 * n THEN -b.m END AS form_n FROM best)",
        "chain AS (SELECT word, form AS root FROM near WHERE form IS NOT NULL UNION SELECT c.word, f.form FROM chain c JOIN near f ON f.word = c.root WHERE f.form IS NOT NULL)",
        "ends AS (SELECT c.word, c.root FROM chain c JOIN near f ON f.word = c.root WHERE f.form IS NULL)",
    ]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT w.word, near.form, coalesce(ends.root, w.word) AS root, w.n, coalesce(near.n_near, 0)::BIGINT AS n_near, near.form_n::BIGINT AS form_n FROM words w LEFT JOIN near USING (word) LEFT JOIN ends USING (word)"


QUERIES = {"op11_spelling": op11_spelling}
ORACLES = {"op11_spelling": _oracle()}
