"""The corpus pipeline: each stage works on all documents that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.llm import bpe, mixing, near_dup, pii, quality
from passagelake.llm.common import table
from passagelake.session import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return near_dup.deduplicate(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: parts that it leaves out are gone, repeats are rows of their own."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text as little-endian unsigned 32-bit integers, the text that they decode to, and hashes of both."""
    decoded = bpe.recode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return decoded.withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("decoded_sha256", F.sha2("text", 256))


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Near-duplicates, boosted trees, quotas and encoding cannot be written in SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
