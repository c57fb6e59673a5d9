"""Token ids in word-aligned Simple-8b files.

A word has 64 bits: 4 of a selector and 60 that hold as many ids of equal width
as fit (or a run of zeros, or one escaped id of up to 60 bits).  A block has a
header, the table of its documents (id and number of ids), the offset of its
words and the words.  Blocks stand one after another in files in ascending
doc_id order; the block header says where the next one begins, and decoding
unpacks all words of one selector together.

Block layout, all numbers little-endian: 4 bytes magic "S8B1"; u32 number of
documents; u64 number of ids; u32 number of words; u32 bytes from the magic to
the first word; i64 doc_id, u8 null flag, u64 number of ids for each document;
u64 words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .binary_files import read_files, write_records
from .shared import new_path, written
from .textbytes import column
from .tokens import encoder, vocabulary
from .worker import task

U = np.uint64
END = 2
VOCABULARY = "word_bpe_49k.json"
MAGIC = b"S8B1"
#: Fixed values of the format: ids a word and bits an id, by selector. Selectors 0 and 1 are runs of 240 and 120 zeros; 15 is an escape, one id of up to 60 bits.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Ids of a block, at least (whole documents; a longer document is a block of its own).
BLOCK_IDS = 1 << 16
#: Files whose sizes are summed up together.
RUN = 4096
#: Bytes of text whose ids one file holds, about.
FILE_TEXT = 16 << 20


def pack(ids: np.ndarray) -> np.ndarray:
    """Words for ids (below 2**60).

    For each place, the selector that takes most ids is found for all places
    together; the loop runs once a word, and the words of one selector are then
    filled together.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, U)
    ids = ids.astype(U)
    if ids.max() >= U(1 << 60):
        raise ValueError("ids must be below 2**60")
    padded = np.concatenate((ids, np.zeros(COUNTS[0], U)))
    narrow = padded.astype(np.uint32) if ids.max() < U(1 << 32) else padded  # cheaper to compare
    chosen = np.full(n, 15, np.int8)  # of a word that starts here: the first selector that fits
    for s in range(14, -1, -1):
        wide = np.zeros(len(padded) + 1, np.int32)
        if BITS[s] < 32 or narrow is padded:
            np.cumsum(narrow >= narrow.dtype.type(1 << BITS[s]), out=wide[1:])
        fits = wide[COUNTS[s] : COUNTS[s] + n] == wide[:n]
        if s < 2:
            fits[max(0, n - COUNTS[s] + 1) :] = False  # runs of zeros are whole
        if not fits.any():
            if s > 1:
                break  # more ids of fewer bits fit nowhere either
            continue
        chosen[fits] = s
    step = np.array(COUNTS)[chosen].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    kind = chosen[at]
    words = kind.astype(U) << U(60)
    for s in np.unique(kind):
        if s >= 2:
            mine = at[kind == s]
            shifts = np.arange(COUNTS[s], dtype=U) * U(BITS[s])
            words[kind == s] |= np.bitwise_or.reduce(padded[mine[:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids that the words hold."""
    kind = (words >> U(60)).astype(np.int64)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.array(COUNTS)[kind], out=at[1:])
    out = np.zeros(max(int(at[-1]), n), U)
    for s in np.unique(kind):
        if s >= 2:
            mine = kind == s
            shifts = np.arange(COUNTS[s], dtype=U) * U(BITS[s])
            out[at[:-1][mine][:, None] + np.arange(COUNTS[s])] = (words[mine][:, None] >> shifts) & U((1 << BITS[s]) - 1)
    return out[:n]


def block(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A block of documents with their ids (unsigned 32-bit, little-endian)."""
    words = pack(np.frombuffer(b"".join(ids), "<u4"))
    table = b"".join(struct.pack("<qBQ", d or 0, d is None, len(i) // 4) for d, i in zip(doc_ids, ids))
    return struct.pack("<4sIQII", MAGIC, len(ids), sum(len(i) for i in ids) // 4, len(words), 24 + len(table)) + table + words.astype("<u8").tobytes()


def blocks(content: bytes) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """doc_ids and ids of each block of a file."""
    at = 0
    while at < len(content):
        magic, docs, n, words, offset = struct.unpack_from("<4sIQII", content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        table = list(struct.iter_unpack("<qBQ", content[at + 24 : at + offset]))
        ids = unpack(np.frombuffer(content, "<u8", words, at + offset), n).astype("<u4")
        ends = np.cumsum([k for _, _, k in table])
        yield [None if null else d for d, null, _ in table], np.split(ids, ends[:-1])
        at += offset + 8 * words + len(SEPARATOR)


#: Stands after each block.
SEPARATOR = b"S8B."


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each text, appends the end id and writes files in ascending doc_id order (null ids first).

    Null and empty texts are one end id; repeated rows are written each.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path).encode
        doc_ids: list = []
        ids: list = []
        size = 0
        for b in batches:
            for d, got in zip(column(b, "doc_id"), encode(column(b, "text"))):
                doc_ids.append(d)
                ids.append(got + end)
                size += len(ids[-1]) // 4
                if size >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([block(doc_ids, ids)], pa.binary())], names=["record"])
                    doc_ids, ids, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([block(doc_ids, ids)], pa.binary())], names=["record"])

    size = source.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    # Rows of one id, of no id among them, are in the order of their texts' hashes, and dealt by it.
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    ordered = source.repartitionByRange(max(1, -(-size // FILE_TEXT)), *order).sortWithinPartitions(*order)
    write_records(ordered.mapInArrow(task(blocked, encodes=True), "record binary"), path, SEPARATOR)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files; start counts the ids of all documents before it."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(column(b, "path"), column(b, "content")):
                at, number = 0, int(file.rsplit("/part-", 1)[1].split("-", 1)[0])
                for doc_ids, ids in blocks(content):  # ids as unsigned 32-bit numbers
                    sizes = np.array([len(i) for i in ids], np.int64)
                    starts = at + np.cumsum(sizes) - sizes
                    at += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes), pa.array([zlib.crc32(i) for i in ids], pa.int64())], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = written(read_files(spark, path).mapInArrow(task(decoded, encodes=True), "file long, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-rows")
    # Ids before each file: sums of runs of files first, so that no window holds more than the square root of very many files.
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("run", F.floor(F.col("file") / RUN))
    earlier = lambda *by: (Window.partitionBy(*by[:-1]) if len(by) > 1 else Window).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = files.groupBy("run").agg(F.sum("n").alias("r")).select("run", F.coalesce(F.sum("r").over(earlier("run")), F.lit(0)).alias("r"))
    files = files.withColumn("f", F.coalesce(F.sum("n").over(earlier("run", "file")), F.lit(0))).join(runs, "run").select("file", (F.col("r") + F.col("f")).alias("before"))
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary(VOCABULARY))
    return read_token_files(spark, path)


QUERIES = {"op7_token_files": op7_token_files}
