"""Persisted text indexes: posting blocks with bounds for ranked search, n-grams for substring search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import scratch_path, table
from .text_jobs import concepts_sql, top_per_group

#: Documents of a block, and for each document that is wanted, blocks that are read to find what it must score.
BLOCK, SEEDS = 8, 2
#: Blocks of a segment, the postings of which a task holds; as many as a long has bits.
BLOCKS = 64
#: Bytes of query tokens, of terms, and of chosen blocks, that are broadcast at most.
SENT = 32 << 20
#: Characters of a gram.
GRAM = 3


def write_index(docs: DataFrame, path: str, id_col: str, fields: dict[str, float], block: int = BLOCK) -> None:
    """Posting blocks of the key words of whole fields: a row for each token and segment, with the blocks that hold it, the largest weight in each, and ids and weights of the documents.

    A block is `block` documents that one task reads one after another, a
    segment BLOCKS blocks, so nothing is shuffled or sorted and a task holds the
    postings of one segment; a hot token has a row for each segment.  Null ids
    are left out; every row is a document of its own.
    """
    # Each field's key words are a column, used once: Spark would find them again for each use.
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *(T.key_words(F.col(f)).alias(f"tokens{n}") for n, f in enumerate(fields)))
    most = F.array(F.struct(F.lit(0).alias("block"), F.lit(0.0).alias("most")))
    schema = rows.select(F.lit("").alias("token"), F.lit(0).cast("long").alias("segment"), most.alias("most"), F.array(F.struct("id", F.lit(0).alias("at"), F.lit(0).alias("block"), F.lit(0.0).alias("weight"))).alias("held")).schema

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for k in range(0, whole.num_rows, block * BLOCKS):
                b = whole.slice(k, block * BLOCKS)
                at = np.concatenate([pc.list_parent_indices(c).to_numpy() for c in b.columns[1:]]).astype(np.int32)
                if not len(at):
                    continue
                words = [pc.list_flatten(c) for c in b.columns[1:]]
                coded = pa.concat_arrays(words).dictionary_encode()
                weight = np.repeat(np.array([float(w) for w in fields.values()]), [len(w) for w in words])
                code = coded.indices.to_numpy()
                order = np.argsort(code.astype(np.int64) * b.num_rows + at, kind="stable")
                code, at, weight = code[order], at[order], weight[order]
                first = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(at, prepend=-1))  # a token may be in several fields
                code, at, weight = code[first], at[first], np.add.reduceat(weight, first)
                begin = np.flatnonzero(np.diff(code, prepend=-1))
                of = at // block
                start = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(of, prepend=-1))
                bound = pa.StructArray.from_arrays([pa.array(of[start]), pa.array(np.maximum.reduceat(weight, start))], names=["block", "most"])
                items = pa.StructArray.from_arrays([b.column(0).take(pa.array(at)), pa.array(at), pa.array(of), pa.array(weight)], names=["id", "at", "block", "weight"])
                lists = [pa.ListArray.from_arrays(pa.array(np.append(ends, len(x)), pa.int32()), x) for ends, x in ((np.searchsorted(start, begin), bound), (begin, items))]
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[begin])), pa.array(np.full(len(begin), number)), *lists], names=["token", "segment", "most", "held"])
                number += 1
        pa.default_memory_pool().release_unused()

    rows.mapInArrow(postings, schema).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """token, segment, most (of each block), held (id, place, block and weight of each document)."""
    return spark.read.parquet(path)


def _hits(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and the index's rows of each of its tokens. Tokens are sent to the index where they take SENT bytes at most; beyond that both are shuffled."""
    tokens = queries.select("query_id", F.explode(T.key_words(F.col("text"))).alias("token"))
    size = tokens.agg(F.sum(F.octet_length("token") + 32)).first()[0] or 0
    return index.join(F.broadcast(tokens) if size <= SENT else tokens, "token")


def bounds(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, block, bound: the blocks in which any of a query's tokens occurs, and at most what a document in them can score."""
    each = _hits(index.select("token", "segment", "most"), queries).select("query_id", "segment", F.explode("most").alias("x"))
    return each.groupBy("query_id", (F.col("segment") * BLOCKS + F.col("x.block")).alias("block")).agg(F.sum("x.most").alias("bound"))


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows, written once and read from there by all that use them."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _scored(index: DataFrame, queries: DataFrame, blocks: DataFrame, allowed: DataFrame | None, k: int) -> DataFrame:
    """query_id, id, score, rank within some blocks of each query. Blocks of a segment travel as the bits of one number; they are sent to the index where they take SENT bytes at most."""
    segments = blocks.groupBy("query_id", F.expr(f"block div {BLOCKS}").alias("segment")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(block % {BLOCKS}))")).alias("open"))
    segments = _kept(segments, "open-blocks")
    few = segments.limit(SENT // 32 + 1).count() <= SENT // 32
    read = _hits(index.select("token", "segment", "held"), queries).join(F.broadcast(segments) if few else segments, ["query_id", "segment"])
    each = read.select("query_id", "segment", "open", F.explode("held").alias("x")).where(F.expr("shiftright(open, x.block) & 1L = 1L"))
    scores = each.groupBy("query_id", "segment", "x.at", "x.id").agg(F.round(F.sum("x.weight"), 6).alias("score"))
    if allowed is not None:
        scores = scores.join(allowed.toDF("id"), "id", "left_semi")
    return top_per_group(scores.groupBy("query_id", "id").agg(F.max("score").alias("score")), ["query_id"], [F.col("score").desc(), "id"], k)


def _chosen(index: DataFrame, queries: DataFrame, bound: DataFrame, k: int, allowed: DataFrame | None, seeds: int) -> DataFrame:
    first = _kept(top_per_group(bound, ["query_id"], [F.col("bound").desc(), "block"], k * seeds).select("query_id", "block"), "first-blocks")
    best = _scored(index, queries, first, allowed, k)
    least = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    kept = bound.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))
    return kept.select("query_id", "block").union(first).distinct()


def chosen_blocks(index: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, seeds: int = SEEDS) -> DataFrame:
    """query_id, block: those that may hold one of the k best documents: the k x `seeds` blocks of the largest bounds, and all whose bound is no less than the score of the k-th best in these."""
    return _chosen(index, queries, _kept(bounds(index, queries), "block-bounds"), k, allowed, seeds)


def indexed_search(index: DataFrame, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None, seeds: int = SEEDS) -> DataFrame:
    """query_id, id, score, rank: the k best documents of each query (query_id, text) by the weights of its tokens; ties by id.

    Blocks whose bound is below what the k-th best document scores aren't opened.
    With allowed, a table of ids, only those count.  Of several documents of one
    id the best counts.
    """
    return _scored(index, queries, chosen_blocks(index, queries, k, allowed, seeds), allowed, k)


def blocks_read(index: DataFrame, queries: DataFrame, k: int = 10, seeds: int = SEEDS) -> DataFrame:
    """query_id, blocks, read: blocks that hold a token of the query, and those of them that a search opens."""
    bound = _kept(bounds(index, queries), "block-bounds")
    every = bound.groupBy("query_id").agg(F.count("*").alias("blocks"))
    return every.join(_chosen(index, queries, bound, k, None, seeds).groupBy("query_id").agg(F.count("*").alias("read")), "query_id")


# --- substrings -----------------------------------------------------------------


def _grams(text: str, sizes: list[int]) -> F.Column:
    """The distinct grams of a text of the given sizes."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(n) for n in sizes)))


def contains_join(texts: DataFrame, terms: DataFrame, text_col: str, term_col: str) -> DataFrame:
    """Rows of texts and terms where the text holds the term, A-Z and other letters in either case.

    A text is looked up by its grams of three characters, a term by the one of
    its grams that the fewest texts hold; texts give shorter grams as well where
    there are terms as short as those.  What shares a gram is compared.  Null
    texts and null or empty terms match nothing.  Columns of both sides are kept
    and must not clash.  Terms are sent to the texts where they take SENT bytes
    at most; beyond that both are shuffled.  The grams of texts are never sent:
    Spark would take them to be as small as the table that they come from.
    """
    t = texts.where(F.col(text_col).isNotNull()).withColumn("__text", F.lower(text_col))
    w = terms.where(F.length(term_col) > 0).withColumn("__term", F.lower(term_col))
    found = w.groupBy(F.least(F.length("__term"), F.lit(GRAM)).alias("n")).agg(F.sum(F.octet_length(F.struct(*w.columns).cast("string")) + 64).alias("bytes")).collect()  # GRAM rows
    sizes, few = sorted(r["n"] for r in found), sum(r["bytes"] for r in found) <= SENT
    if not sizes:
        return t.crossJoin(w).limit(0).drop("__text", "__term")
    sent = F.broadcast if few else lambda df: df.hint("merge")
    held = t.withColumn("__gram", F.explode(_grams("__text", sizes)))
    own = w.select("__term").distinct().withColumn("__gram", F.explode(_grams("__term", sizes))).where(F.length("__gram") == F.least(F.length("__term"), F.lit(GRAM)))
    # Only grams of terms are counted, so there are no more counts than those.
    often = held.select("__gram").join(sent(own.select("__gram").distinct()), "__gram", "left_semi").groupBy("__gram").agg(F.count("*").alias("__n"))
    # A term with a gram that no text holds is in none: the inner join keeps it out below, where its grams are counted.
    counted = own.join(sent(often), "__gram", "left").groupBy("__term").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("g"))).alias("x")).where("x.n > 0")
    rare = w.join(counted.select("__term", F.col("x.g").alias("__gram")), "__term")
    return held.join(sent(rare), "__gram").where(F.contains("__text", "__term")).drop("__gram", "__text", "__term")


# --- queries --------------------------------------------------------------------

_written: dict[tuple[str, str], str] = {}


def document_index(s: SparkSession, d: str) -> DataFrame:
    """The index of documents, written once in a session for each folder of tables."""
    key = (s.sparkContext.applicationId, d)
    if key not in _written:
        path = scratch_path(s, "text-index")
        write_index(table(s, d, "documents"), path, "doc_id", {"text": 1.0, "source": 2.0})
        _written[key] = path
    return read_index(s, _written[key])


def _queries(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def _terms(s, d) -> DataFrame:
    """Search terms: parts of the names of regions, nations and suppliers, from one character up."""
    part = lambda t, c, n: table(s, d, t).select(F.lower(F.substring(c, 2, n)).alias("term"))
    return part("region", "r_name", 2).union(part("nation", "n_name", 3)).union(part("nation", "n_name", 1)).union(table(s, d, "part").where("p_size < 3").select(F.substring("p_name", 4, 7))).distinct()


_INDEX = f"(SELECT doc_id, keyword AS token, sum(w) AS weight FROM (SELECT doc_id, keyword, 1.0::DOUBLE AS w FROM ({concepts_sql('doc_id', 'text', most=None)}) UNION ALL SELECT doc_id, keyword, 2.0::DOUBLE FROM ({concepts_sql('doc_id', 'source', most=None)})) GROUP BY 1, 2)"
_TERMS = "(SELECT DISTINCT term FROM (SELECT lower(r_name[2:3]) AS term FROM region UNION ALL SELECT lower(n_name[2:4]) FROM nation UNION ALL SELECT lower(n_name[2:2]) FROM nation UNION ALL SELECT p_name[4:10] FROM part WHERE p_size < 3))"


def _searched(where: str, k: int) -> str:
    return f"SELECT query_id, doc_id, round(sum(weight), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(weight), 6) DESC, doc_id) AS rank FROM (SELECT item_id AS query_id, keyword AS token FROM ({concepts_sql('item_id', 'text', 'benchmark', None)})) JOIN {_INDEX} USING (token) WHERE {where} GROUP BY 1, 2 QUALIFY rank <= {k}"


QUERIES = {
    "a2_name_search": lambda s, d: contains_join(table(s, d, "part").select("p_partkey", "p_name"), _terms(s, d), "p_name", "term"),
    "h11_filtered_search": lambda s, d: _found(indexed_search(document_index(s, d), _queries(s, d), 5, table(s, d, "documents").where("lang = 'en'").select("doc_id"))),
    "h11_field_search": lambda s, d: _found(indexed_search(document_index(s, d), _queries(s, d))),
    "h11_blocks_read": lambda s, d: blocks_read(document_index(s, d), _queries(s, d)),
}
ORACLES = {
    "a2_name_search": f"SELECT p_partkey, p_name, term FROM part JOIN {_TERMS} ON contains(lower(p_name), lower(term)) WHERE term <> ''",
    "h11_filtered_search": _searched("doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')", 5),
    "h11_field_search": _searched("true", 10),
}
