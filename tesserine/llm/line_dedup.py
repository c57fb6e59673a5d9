"""Line dedup by winnowing over line hashes.

The unit is a run of consecutive lines of at least MIN_WORDS words.  For each
line, the shortest such run that begins with it and the shortest that ends with
it are its windows.  Each window selects its smallest line hash as fingerprint,
which any other occurrence of the same lines selects as well, so every repeated
run shares fingerprints with its first occurrence.  Windows next to each other
mostly select the same line, so there are far fewer fingerprint positions than
windows; those of hashes that recur are found first, and only their windows are
shuffled and joined by fingerprint, each with the first position of the same
window.  Matched positions are extended line by line
in both directions as far as the two texts agree, and the lines of the run are
deleted in the later one.

A window's digest is part of the join's key, so a line that stands in very many
texts brings each of its positions one partner, and not all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, written
from .textbytes import column
from .worker import fresh, task

#: Words that a repeated run has at least.
MIN_WORDS = 50


def windows(counts: list[int], least: int) -> list[tuple[int, int]]:
    """(first, end) of the shortest runs of at least `least` words that begin or end at each line, without doubles."""
    n, sums = len(counts), [0]
    for c in counts:
        sums.append(sums[-1] + c)
    if sums[-1] < least:
        return []
    found, j = set(), 0
    for i in range(n):  # begins at i
        while j <= n and sums[j] - sums[i] < least:
            j += 1
        if j > n:
            break
        found.add((i, j))
    i = n
    for j in range(n, 0, -1):  # ends before j
        i = min(i, j)
        while i >= 0 and sums[j] - sums[i] < least:
            i -= 1
        if i < 0:
            break
        found.add((i, j))
    return sorted(found)


def fingerprints(text: str, least: int) -> tuple[list[int], list[int], list[int], list[tuple[int, int, bytes]]]:
    """Hash, words and number of each line that isn't blank, and (hash, line, digest of the window) of the fingerprint of each window."""
    lines = [(k, words) for k, line in enumerate(text.split("\n")) if (words := line.split())]  # blank lines don't count
    counts = [len(words) for _, words in lines]
    found = windows(counts, least)
    if not found:
        return [], [], [], []
    hashes = [xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63) for _, words in lines]
    packed, prints = np.array(hashes, "<i8").tobytes(), []
    for i, j in found:
        smallest = min(hashes[i:j])
        prints.append((smallest, hashes.index(smallest, i, j), xxhash.xxh3_128_digest(packed[8 * i : 8 * j])))
    return hashes, counts, [k for k, _ in lines], prints


def extended(a: np.ndarray, b: np.ndarray, at: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs (first, end) of a that equal b around matched positions (place in a, place in b)."""
    runs, reached = [], {}
    for p, q in sorted(at):
        if p < reached.get(q - p, 0):
            continue  # of a run that has been found
        n, m = min(len(a) - p, len(b) - q), min(p, q)
        after, before = np.flatnonzero(a[p : p + n] != b[q : q + n]), np.flatnonzero(a[p - m : p][::-1] != b[q - m : q][::-1])
        end = p + int(after[0] if len(after) else n)
        if end > p:
            runs.append((p - int(before[0] if len(before) else m), end))
            reached[q - p] = end
    return runs


def _same(a: str, b: str) -> F.Column:
    """Whether two document keys (id and hash of the text) agree."""
    return F.col(f"{a}id").eqNullSafe(F.col(f"{b}id")) & (F.col(f"{a}h") == F.col(f"{b}h"))


def candidates(texts: DataFrame) -> DataFrame:
    """id, h, fp, place, digest: the windows whose fingerprint stands at two positions or more.

    Only fingerprint positions are counted, one for each line that any window
    selects, and summed before they are shuffled; windows whose fingerprint
    stands nowhere else stay where they are, and the digest of a window is only
    compared among those of one fingerprint.  A fingerprint that very many texts
    share is split by the rest of its windows, of which the digest tells.
    """
    at = F.struct("id", "h", "place")
    thinned = texts.select("id", "h", F.inline(F.array_distinct(F.transform("prints", lambda p: F.struct(p["fp"].alias("fp"), p["place"].alias("place"))))))
    recurring = thinned.groupBy("fp").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a < b").select("fp")
    return texts.select("id", "h", F.inline("prints")).join(written(recurring, "line-fingerprints"), "fp", "left_semi").select("id", "h", "fp", "place", "digest")


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, str, str] = ("n_lines", "n_removed", "n_removed_words")) -> DataFrame:
    """docs with its text column without later repeated runs, and n_lines, n_removed, n_removed_words (replaced if there; outputs may name them otherwise).

    Lines are compared without their white space's kind and amount; blank lines
    don't count, and go with a run that they stand in.  Occurrences are ordered by id (null first), text hash and line.  Of repeated
    runs that overlap each other within a text, the lines of every occurrence but
    the first are deleted.  Rows repeated with id and text count as one
    occurrence and lose the same lines; null and empty texts have no runs and
    stay as they are.  A text all of whose lines go becomes empty.  Other columns
    are kept as they are, whatever their names.
    """
    spark = docs.sparkSession
    types = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("lines", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("numbers", pa.list_(pa.int32())), ("prints", pa.list_(pa.struct([("fp", pa.int64()), ("place", pa.int32()), ("digest", pa.binary())])))])

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, h, text in zip(column(b, "id"), column(b, "h"), column(b, "text")):
                hashes, counts, numbers, prints = fingerprints(text or "", least)
                if prints:
                    rows.append({"id": d, "h": h, "lines": hashes, "words": counts, "numbers": numbers, "prints": [{"fp": f, "place": p, "digest": g} for f, p, g in prints]})
            yield pa.RecordBatch.from_pylist(rows, types)

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    schema = "id long, h long, lines array<long>, words array<int>, numbers array<int>, prints array<struct<fp:long,place:int,digest:binary>>"
    texts = written(plain.mapInArrow(task(selected), schema), "line-hashes")

    close = written(candidates(texts), "line-candidates")
    at = F.struct("id", "h", "place")
    first = close.groupBy("fp", "digest").agg(F.min(at).alias("source"), F.max(at).alias("last")).where("source < last").select("fp", "digest", "source")
    pairs = close.join(written(first, "line-sources"), ["fp", "digest"]).where(at > F.col("source")).select("id", "h", "place", F.col("source.id").alias("sid"), F.col("source.h").alias("sh"), F.col("source.place").alias("splace"))
    matches = written(pairs.groupBy("id", "h", "sid", "sh").agg(F.collect_set(F.struct("place", "splace")).alias("at")), "line-matches")  # of two texts: at most two windows a line

    # The line hashes of both texts come to their matched positions.
    sides = matches.select("id", "h").union(matches.select("sid", "sh")).distinct().select(F.col("id").alias("jid"), F.col("h").alias("jh"))
    involved = texts.join(sides, _same("", "j"), "left_semi").groupBy("id", "h").agg(*(F.first(c).alias(c) for c in ("lines", "words", "numbers")))
    involved = written(involved, "line-texts")
    sources = involved.select(F.col("id").alias("jid"), F.col("h").alias("jh"), F.col("lines").alias("slines"))
    both = matches.join(sources, _same("s", "j")).select("id", "h", "at", "slines").join(involved.withColumnsRenamed({"id": "jid", "h": "jh"}), _same("", "j")).select("id", "h", "at", "slines", "lines", "words", "numbers")

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, h, places, theirs, mine, words, numbers in zip(*(column(b, c) for c in ("id", "h", "at", "slines", "lines", "words", "numbers"))):
                for i, j in extended(np.array(mine), np.array(theirs), [(x["place"], x["splace"]) for x in places]):
                    if sum(words[i:j]) >= least:
                        rows.append({"id": d, "h": h, "first": numbers[i], "end": numbers[j - 1] + 1})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("h", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))

    own_id, own_h, other_id, other_h, gone = fresh(docs, "__id", "__h", "__id2", "__h2", "__gone")
    runs = both.mapInArrow(task(grown), "id long, h long, first int, end int")
    runs = runs.groupBy(F.col("id").alias(other_id), F.col("h").alias(other_h)).agg(F.collect_set(F.struct("first", "end")).alias(gone))  # of one text: no more than it has lines
    runs = written(runs, "line-runs")
    dropped(spark, texts, close, matches, involved)

    rest = [c for c in docs.columns if c.lower() not in {o.lower() for o in outputs}]
    # The runs grow with the documents: one plan for every size.
    key = [F.col(id_col).cast("long").alias(own_id), F.xxhash64(text_col).alias(own_h)]
    kept = [F.col(f"`{c}`") for c in rest]
    marked = docs.select(*kept, *key).join(runs.hint("merge"), F.col(own_id).eqNullSafe(F.col(other_id)) & (F.col(own_h) == F.col(other_h)), "left").select(*kept, gone)
    schema = docs.select(*kept, *(F.lit(0).alias(c) for c in outputs)).schema
    column_at = rest.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = column(b, text_col), [[], [], []]
            for k, (text, runs) in enumerate(zip(texts, column(b, gone))):
                lines = text.split("\n") if text else []
                out = {i for g in runs or () for i in range(g["first"], g["end"])}
                if out:
                    texts[k] = "\n".join(line for i, line in enumerate(lines) if i not in out)
                for to, v in zip(counts, (len(lines), len(out), sum(len(lines[i].split()) for i in out))):
                    to.append(v)
            columns = list(b.columns[:-1])
            columns[column_at] = pa.array(texts, columns[column_at].type)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int32()) for c in counts)], names=schema.names)

    return marked.mapInArrow(task(cut), schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed", "n_removed_words")


def _oracle(least: int = MIN_WORDS) -> str:
    """All shortest runs of enough words that begin or end at a line; those whose lines have been seen before lose theirs."""
    lines = "SELECT doc_id, text, k, l, len(w) AS n, array_to_string(w, ' ') AS line FROM (SELECT doc_id, text, k, string_split(text, chr(10))[k] AS l, list_filter(string_split_regex(string_split(text, chr(10))[k], '\\s+'), lambda x: x <> '') AS w FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text <> ''))"
    return f"""WITH l AS ({lines}), s AS (SELECT doc_id, k, n, line, row_number() OVER d AS i, sum(n) OVER d AS upto FROM l WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
 spans AS (SELECT a.doc_id, a.i AS i, min(b.i) AS j FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {least} GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.i), b.i FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {least} GROUP BY 1, b.i),
 runs AS (SELECT p.doc_id, p.i, p.j, min(s.k) AS first, max(s.k) AS last, md5(string_agg(s.line, chr(10) ORDER BY s.i)) AS digest FROM spans p JOIN s ON p.doc_id = s.doc_id AND s.i BETWEEN p.i AND p.j GROUP BY 1, 2, 3),
 later AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id, i) > 1),
 gone AS (SELECT DISTINCT l.doc_id, l.k FROM l JOIN later r ON l.doc_id = r.doc_id AND l.k BETWEEN r.first AND r.last),
 cut AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.k) AS n_removed, coalesce(sum(l.n) FILTER (gone.k IS NOT NULL), 0) AS words, coalesce(string_agg(l.l, chr(10) ORDER BY l.k) FILTER (gone.k IS NULL), '') AS kept FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.k = gone.k GROUP BY 1)
 SELECT doc_id, CASE WHEN n_removed > 0 THEN kept ELSE text END AS text, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, coalesce(words, 0)::INT AS n_removed_words FROM documents LEFT JOIN cut USING (doc_id)"""


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {"op10_line_dedup": _oracle()}
