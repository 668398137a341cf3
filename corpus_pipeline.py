"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, mixing, quality, token_blocks
from tidemark.storage import materialise


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the one of the least doc_id."""
    return jaccard_join.without_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order in which their sources are mixed."""
    return mixing.in_mixed_order(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in the order that the documents are stored in, and their digests."""
    return token_blocks.token_digest(spark, stored_order(docs), public_tokenizers.path("word_bpe_49k.json"), order="__at")


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed_sources),
    ("token ids", token_ids),
]
ORACLE_SQL = None  # a learned classifier and a schedule have no SQL; tests hold run() against a brute-force version


def stored_order(docs: DataFrame) -> DataFrame:
    """doc_id and text with ``__at``, a number that grows in the order of a table's files and rows.

    Tasks read files in any order, so a stored table's rows are numbered by file and row; a table that no files hold
    is numbered by partition and row.
    """
    if docs.inputFiles():
        file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
        at = F.coalesce(file, F.lit(0)) * (1 << 40) + F.col("_metadata.row_index")
    else:
        at = F.monotonically_increasing_id()
    return docs.select("doc_id", "text", at.alias("__at"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
