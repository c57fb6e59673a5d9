"""The corpus pipeline: documents to packed training sequences in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.decontaminate import find_items
from tesserine.llm.line_dedup import dedup_lines
from tesserine.llm.near_dup import without_near_duplicates
from tesserine.llm.packing import VOCABULARY, pack_documents
from tesserine.llm.quality import THRESHOLD, quality_network, score_quality
from tesserine.llm.shared import written
from tesserine.llm.tokens import vocabulary
from tesserine.llm.worker import fresh


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows of the documents table."""
    net = quality_network(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "score")
    return score_quality(docs, net, output=score).where(F.col(score) >= THRESHOLD).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those of which nothing is left go. n_chars follows the text."""
    lines, removed, words = fresh(docs, "n_lines", "n_removed", "n_removed_words")
    cut = dedup_lines(docs, outputs=(lines, removed, words)).where((F.col(removed) == 0) | (F.length(F.trim("text")) > 0))
    return cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    words, runs, items = fresh(docs, "n_words", "runs", "items")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns), outputs=(words, runs, items))
    return found.where(F.size(items) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return pack_documents(docs, vocabulary(VOCABULARY))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't state the classifier, the samples or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None
