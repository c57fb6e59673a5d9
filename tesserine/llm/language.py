"""Language identification: a linear-chain conditional random field over words.

Words are runs of ASCII letters and non-ASCII bytes, case folded as far as
Latin-1 goes.  A word's features are its affixes of 1 to 3 bytes, all of its
n-grams of 2 to 4 bytes with its edges, whether it is in the lexicon of a
language (the words that the language's training texts hold most), and a
constant; affixes and n-grams are hashed.  A chain runs over the words of a line,
a longer line is several chains of CHAIN words (and a chain ends where a text is
cut into pieces of PART bytes).  Forward-backward gives every
word its probability of each language, so a text whose languages switch is
labelled word by word; the prediction for a document is the language with the
largest mean over its words.

The field learns on the driver from a sample with documented bounds.  All words
of a training document bear its language; so that switches are learned too,
chains are joined from pieces of lines of several documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import remainder
from .textbytes import U, chunks, column, joined, span_hashes, spans
from .worker import fresh, task

#: Bounds of the sample: documents of a language, documents in all, bytes of them.
SAMPLE_LANG, SAMPLE_DOCS, SAMPLE_BYTES = 512, 3000, 4 << 20
#: Rows of the table of hashed features, words of a language's lexicon, words of a chain.
ROWS, LEXICON, CHAIN = 1 << 16, 1000, 128
EPOCHS, RATE, DECAY = 3, 0.05, 1e-6
#: Bytes of text that are learned from or labelled at a time.
PART = 1 << 18
UNKNOWN = "und"

#: Bytes of words.
_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a run of texts: features and chains."""

    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # rows of hashed features; the words that have some, and where theirs begin
    hashes: np.ndarray  # of whole words
    text: np.ndarray  # index of each word's text
    line: np.ndarray  # number of each word's line

    @classmethod
    def of(cls, texts: list[bytes]) -> "Words":
        data, at = joined(texts)
        data = _LOWER[data]
        capital = np.zeros(len(data), bool)  # second bytes of U+00C0 to U+00DE
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[capital] += 32
        kind = _WORD[data]
        starts, ends = spans(kind)
        text = np.searchsorted(at, starts, side="right") - 1
        line = np.cumsum(data == 10)[starts]
        if not len(starts):
            return cls([], np.zeros(0, U), text, line)
        # The words in an array of their own, one space (the edge) before and after each.
        sizes = ends - starts
        place = np.cumsum(sizes + 1) - sizes
        own = np.full(int(place[-1] + sizes[-1]) + 4, 32, np.uint32)
        inside = np.flatnonzero(kind)
        own[inside + np.repeat(place - starts, sizes)] = data[inside]
        groups = []
        for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77), (4, 0xC2B2AE3D)):
            words = np.flatnonzero(sizes + 3 > n)
            counts = sizes[words] + 3 - n
            first = np.cumsum(counts) - counts
            begin = np.repeat(place[words] - 1 - first, counts) + np.arange(int(counts.sum()))
            groups.append((cls._row(cls._code(own, begin, n), salt), words, first))
        for k, salt in ((1, 0x27D4EB2F), (2, 0x165667B1), (3, 0xD3A2646C)):
            words = np.flatnonzero(sizes >= k)
            for begin, turn in ((place[words], 0), (place[words] + sizes[words] - k, 0x5BD1E995)):
                groups.append((cls._row(cls._code(own, begin, k), salt ^ turn), words, np.arange(len(words))))
        return cls([g for g in groups if len(g[1])], span_hashes(data, starts, ends), text, line)

    @staticmethod
    def _code(own: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
        code = own[begin]
        for j in range(1, n):
            code = code << np.uint32(8) | own[begin + j]
        return code

    @staticmethod
    def _row(code: np.ndarray, salt: int) -> np.ndarray:
        x = (code ^ np.uint32(salt)) * np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        return (x >> np.uint32(16) & np.uint32(ROWS - 1)).astype(np.int64)


def chained(line: np.ndarray, most: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the chains: lines, cut every `most` words."""
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(np.append(begin, len(line)))
    pieces = -(-size // most)
    start = np.repeat(begin, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
    end = np.append(start[1:], len(line))
    return start, end - start


@dataclass
class Field:
    langs: list[str]
    table: np.ndarray  # ROWS x langs
    bias: np.ndarray  # langs
    lexicon: np.ndarray  # hashes of words, ascending
    member: np.ndarray  # lexicon words x langs: in the lexicon of a language
    known: np.ndarray  # langs x langs: weight for a label of being in a lexicon
    moves: np.ndarray  # langs x langs: from, to
    begin: np.ndarray  # langs

    def members(self, hashes: np.ndarray) -> np.ndarray:
        """In which lexicons words are."""
        out = np.zeros((len(hashes), len(self.langs)), np.float32)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            hit = self.lexicon[at] == hashes
            out[hit] = self.member[at[hit]]
        return out

    def scores(self, words: Words, member: np.ndarray) -> np.ndarray:
        out = self.bias + member @ self.known
        for rows, own, first in words.groups:
            weights = self.table[rows]
            out[own] += weights if len(rows) == len(own) else np.add.reduceat(weights, first)
        return out

    def marginals(self, scores: np.ndarray, start: np.ndarray, size: np.ndarray, moved: np.ndarray | None = None) -> np.ndarray:
        """Probability of each language for each word by forward-backward over chains that are numbered by length; moved: gets the expected moves."""
        n = len(self.langs)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        seen = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
        moves, begin = np.exp(self.moves - self.moves.max()), np.exp(self.begin - self.begin.max())
        longest = int(size[0])
        alive = np.searchsorted(-size, -np.arange(longest), side="left")  # chains with a word at each place
        forward = np.empty((len(scores), n))
        a = begin * seen[start]
        a /= a.sum(axis=1, keepdims=True)
        forward[start] = a
        for t in range(1, longest):
            at = start[: alive[t]] + t
            a = (a[: alive[t]] @ moves) * seen[at]
            a /= a.sum(axis=1, keepdims=True)
            forward[at] = a
        b = np.ones((len(start), n))
        for t in range(longest - 1, 0, -1):
            m = alive[t]
            at = start[:m] + t
            weighted = seen[at] * b[:m]
            before = weighted @ moves.T
            if moved is not None:
                both = (forward[at - 1] / (forward[at - 1] * before).sum(axis=1, keepdims=True)).T @ weighted
                moved += both * moves
            b[:m] = before / before.sum(axis=1, keepdims=True)
            forward[at - 1] *= b[:m]
        return forward / forward.sum(axis=1, keepdims=True)

    def label(self, texts: list[bytes]) -> tuple[Words, np.ndarray]:
        """The words of texts and their marginals."""
        words = Words.of(texts)
        if not len(words.hashes) or not self.langs:
            return words, np.zeros((len(words.hashes), len(self.langs)))
        return words, self.marginals(self.scores(words, self.members(words.hashes)), *chained(words.line))

    def predict(self, texts: list[bytes], runs: bool = True) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """For each text its language, the mean probability of that, and its runs of words of one language (first word, words, language)."""
        n = len(self.langs)
        cut = [(i, piece) for i, t in enumerate(texts) for piece in pieces(t)]
        total, count = np.zeros((len(texts), n)), np.zeros(len(texts), np.int64)
        letter, found = [False] * len(texts), [[] for _ in texts]
        for begin, run in chunks([piece for _, piece in cut], PART):
            words, p = self.label(run)
            edges = np.searchsorted(words.text, np.arange(len(run) + 1))
            best = p.argmax(axis=1) if p.size else np.zeros(len(p), np.int64)
            for k, piece in enumerate(run):
                i, a, b = cut[begin + k][0], int(edges[k]), int(edges[k + 1])
                if a == b or not n:
                    continue
                letter[i] = letter[i] or has_letter(piece)
                if runs:
                    turn = np.flatnonzero(np.diff(best[a:b], prepend=-1))
                    for s, e in zip(turn, [*turn[1:], b - a]):
                        lang, so_far = self.langs[best[a + s]], found[i]
                        if so_far and so_far[-1][2] == lang:
                            so_far[-1] = (so_far[-1][0], so_far[-1][1] + int(e - s), lang)
                        else:
                            so_far.append((int(count[i] + s), int(e - s), lang))
                total[i] += p[a:b].sum(axis=0)
                count[i] += b - a
        mean = total / np.maximum(count, 1)[:, None]
        return [(self.langs[k := int(m.argmax())], float(min(1.0, m[k])), r) if known else (UNKNOWN, 0.0, []) for m, known, r in zip(mean, letter, found)]


def pieces(text: bytes) -> list[bytes]:
    """A text in pieces of at most PART bytes, cut behind the last byte of a piece that isn't part of a word."""
    out = []
    while len(text) > PART:
        ends = np.flatnonzero(~_WORD[np.frombuffer(text[:PART], np.uint8)])
        k = int(ends[-1]) + 1 if len(ends) else PART
        out.append(text[:k])
        text = text[k:]
    return [*out, text]


def has_letter(text: bytes) -> bool:
    """Whether a text has a letter of any script."""
    return any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def _lexicons(words: list[Words], of_text: list[np.ndarray], langs: int) -> tuple[np.ndarray, np.ndarray]:
    """The LEXICON most frequent words of each language (ties: smaller hash)."""
    counts: list[Counter] = [Counter() for _ in range(langs)]
    for w, y in zip(words, of_text):
        for k in range(langs):
            counts[k].update(w.hashes[y == k].tolist())
    tops = [{h for h, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]} for c in counts]
    every = np.array(sorted(set().union(*tops)) if tops else [], U)
    return every, np.array([[h in t for t in tops] for h in every.tolist()], np.float32).reshape(len(every), langs)


def _switched(start: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Words in the order of chains that are joined from pieces of others, and the number of each chain."""
    pieces = [(s + k, min(n - k, 12)) for s, n in zip(start.tolist(), size.tolist()) for k in range(0, n, 12)]
    rng.shuffle(pieces)
    order = np.concatenate([np.arange(s, s + n) for s, n in pieces])
    chain = np.repeat(np.arange(len(pieces)) // 3, [n for _, n in pieces])
    return order, chain


def fit(texts: list[bytes], langs: list[str], seed: int = 3) -> Field:
    """Gradient ascent (Adagrad) on the likelihood; each epoch goes once over the lines as they are and once over joined pieces of them."""
    names = sorted(set(langs))
    n, rng = len(names), np.random.default_rng(seed)
    field = Field(names, np.zeros((ROWS, n), np.float32), np.zeros(n, np.float32), np.zeros(0, U), np.zeros((0, n), np.float32), np.zeros((n, n), np.float32), np.zeros((n, n)), np.zeros(n))
    if n < 2:
        return field
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(texts))
    parts = [([texts[k] for k in order[first : first + len(run)]], y[order[first : first + len(run)]]) for first, run in chunks([texts[k] for k in order], PART)]
    work = [(w, of[w.text]) for w, of in ((Words.of(t), of) for t, of in parts) if len(w.hashes)]
    field.lexicon, field.member = _lexicons([w for w, _ in work], [of for _, of in work], n)
    params = [field.table, field.bias, field.known, field.moves, field.begin]
    squares = [np.full(p.shape, 1e-6) for p in params]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(work)):
            words, label = work[k]
            member = field.members(words.hashes)
            plain = chained(words.line)
            mixed_order, mixed_chain = _switched(*plain, rng)
            for take, (start, size) in ((np.arange(len(label)), plain), (mixed_order, chained(mixed_chain))):
                own, scores, expected = label[take], field.scores(words, member)[take], np.zeros((n, n))
                error = -field.marginals(scores, start, size, expected)
                error[np.arange(len(own)), own] += 1
                moved = -expected
                inner = np.ones(len(own), bool)
                inner[start] = False
                at = np.flatnonzero(inner)
                np.add.at(moved, (own[at - 1], own[at]), 1)
                back = np.empty_like(error)
                back[take] = error
                table = np.zeros((ROWS, n))
                for rows, whose, first in words.groups:
                    each = np.repeat(whose, np.diff(np.append(first, len(rows))))
                    for c in range(n):
                        table[:, c] += np.bincount(rows, back[each, c], ROWS)
                for p, g, s in zip(params, (table, back.sum(axis=0), member.T @ back, moved, error[start].sum(axis=0)), squares):
                    g = g / len(own) - DECAY * p
                    s += g * g
                    p += (RATE * g / np.sqrt(s)).astype(p.dtype)
    return field


def labelled_sample(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[bytes], list[str]]:
    """Texts and languages of at most SAMPLE_LANG documents of a language, SAMPLE_DOCS in all, in the order of hashed ids; longer ones than what is left of SAMPLE_BYTES are passed over.

    Of each language and each of SAMPLE_LANG values of the hash the document
    with the smallest is taken, which partial sums find.  Documents with null id,
    text or language are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("t")).where(learn).where("id is not null and lang is not null and t is not null")
    order = F.xxhash64("id")
    least = rows.select("lang", F.struct(order.alias("o"), F.col("id"), F.octet_length("t").alias("n"), F.md5("t").alias("m")).alias("r")).groupBy("lang", F.pmod("r.o", F.lit(SAMPLE_LANG)).alias("slot")).agg(F.min("r").alias("r"))
    spread = F.pmod(F.xxhash64(F.col("r.o"), F.lit(1)), F.lit(1 << 40))
    chosen, left = [], SAMPLE_BYTES
    for r in least.select("lang", "r.*").orderBy(spread, "lang", "r.id").limit(SAMPLE_DOCS).collect():
        if r["n"] <= left:
            chosen.append((r["id"], r["lang"], r["m"], r["o"]))
            left -= r["n"]
    if not chosen:
        return [], []
    few = docs.sparkSession.createDataFrame(chosen, rows.select(F.col("id"), F.col("lang"), F.md5("t").alias("m"), order.alias("o")).schema)
    got = rows.withColumn("m", F.md5("t")).join(F.broadcast(few), ["id", "lang", "m"]).dropDuplicates(["id", "lang", "m"]).select("o", "lang", "t").collect()
    got.sort(key=lambda r: (r["o"], r["lang"], bytes(r["t"])))
    return [bytes(r["t"]) for r in got], [r["lang"] for r in got]


def predict_languages(docs: DataFrame, field: Field, text_col: str = "text", outputs: tuple[str, str] = ("lang_pred", "score"), runs: str | None = None) -> DataFrame:
    """docs with the predicted language and its mean probability, and with `runs` a column of the runs of words of one language.

    Null texts and texts without a letter of any script get `und`, a score of 0
    and no runs; so do all where the field learned no language.  Texts of any
    length are taken whole.  All columns of docs are kept, whatever their names;
    those named like an output are replaced.  Nothing is shuffled.
    """
    spark = docs.sparkSession
    rest = docs.drop(*outputs, *([runs] if runs else []))
    (text,) = fresh(docs, "__text")
    plain = docs.select(*(F.col(f"`{c}`") for c in rest.columns), F.col(f"`{text_col}`").cast("binary").alias(text))
    made = rest.withColumns({outputs[0]: F.lit(""), outputs[1]: F.lit(0.0)})
    if runs:
        made = made.withColumn(runs, F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("words"), F.lit("").alias("lang"))))
    schema = made.schema
    sent = spark.sparkContext.broadcast(field)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for b in batches:
            found = [r for _, part in chunks(column(b, text), PART) for r in field.predict(part, bool(runs))]
            columns = [pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float64())]
            if runs:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
                columns.append(pa.array([[{"first": f, "words": n, "lang": x} for f, n, x in r[2]] for r in found], kind))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=schema.names)

    return plain.mapInArrow(task(predicted), schema)


def language_field(docs: DataFrame) -> Field:
    """The field that learns from documents outside fold 2 of 4."""
    return fit(*labelled_sample(docs, remainder("id", 4) != 2))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict_languages(docs.select("doc_id", "text"), language_field(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op13_language": op13_language}
