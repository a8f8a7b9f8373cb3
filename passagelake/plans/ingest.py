"""Bulk ingest: files through gates, extraction, chunking and embedding to two tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.functions.encoders import EncoderFactory, HashingEncoder, embed
from passagelake.functions.extract import extract_text
from passagelake.functions.text import (
    CHUNK_WORDS, bucket_name, cutting_text, estimated_time, extension_allowed, minio_link,
    normalize_filename, size_allowed, slug_lookup, taille_chunk,
)
from passagelake.operators.guards import upload_gate_outcome
from passagelake.session import materialise, through_driver


@dataclass
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    quarantine: DataFrame


def explode_chunks(df: DataFrame, text: str = "text", max_length: int = CHUNK_WORDS) -> DataFrame:
    """One row per chunk with ``chunk_index``, ``chunk_text`` and ``taille_chunk``."""
    return _one_row_each(df.withColumn(text, cutting_text(F.col(text), max_length)), text)


def _one_row_each(df: DataFrame, chunks: str) -> DataFrame:
    rest = [c for c in df.columns if c != chunks]
    return df.select(*rest, F.posexplode(chunks).alias("chunk_index", "chunk_text")).withColumn(
        "taille_chunk", taille_chunk(F.col("chunk_text"))
    )


def embed_chunks(
    chunks: DataFrame, encoder: EncoderFactory = HashingEncoder(), column: str = "embedding", text: str = "chunk_text",
    partitions: int | None = None,
) -> DataFrame:
    """Chunks with their vectors.

    Texts differ a lot in length, so before a costly encoder the chunks are
    spread evenly with ``partitions``; the hashing encoder does not need it.
    """
    spread = chunks.repartition(partitions) if partitions else chunks
    return spread.withColumn(column, embed(F.col(text), encoder))


def embed_queries(queries: DataFrame, encoder: EncoderFactory = HashingEncoder(), text: str = "query") -> DataFrame:
    """Queries with the vector of their text, from the encoder the chunks were embedded with."""
    return queries.withColumn("embedding", embed(F.col(text), encoder))


def upload_key(uploads: DataFrame) -> Column:
    """Stable document id of an upload: the same upload gets it again on a retry."""
    return F.col("upload_id").cast("long")


def ingest(
    files: DataFrame,
    stored: DataFrame,
    now: Column,
    posted_by: Column,
    encoder: EncoderFactory = HashingEncoder(),
    document_id: Callable[[DataFrame], Column] = upload_key,
    pdf_decoder: Callable[[bytes], str] | None = None,
    embed_partitions: int | None = None,
    small_batch: bool = False,
) -> Ingested:
    """Documents, chunks and rejects of a batch of uploads.

    ``files``: ``upload_id, arrival, collection_id, collection_name, title,
    filename, size_bytes, content``. ``stored`` is the current document table.
    The guards see names and sizes only. Contents are read for files that pass
    the extension and size gates, and meet the accepted ids in one join that
    builds on the ids and sorts no contents; as those ids are unique it also spreads the files evenly for what follows. The
    texts, cut to chunks, and the rejects are written to the shared folder once, so the results
    neither extract nor cut nor judge again.

    A batch of a stream cannot leave its contents out of a scan. So with ``small_batch``, a bounded number of uploads,
    the names are collected first, and the guards do not read the files again; verdicts are collected too, and ids are
    broadcast. Such a batch costs a job for its names, a few small ones for the guards, and one for its texts.
    """
    named = files.withColumn("title_document", normalize_filename(F.col("filename")))
    names = through_driver(files.drop("content")) if small_batch else files.drop("content")
    verdicts = upload_gate_outcome(names, stored, small_batch)
    verdicts = through_driver(verdicts).coalesce(1) if small_batch else verdicts
    accepted = verdicts.filter("outcome = 'accepted'").select("upload_id")
    accepted = F.broadcast(accepted) if small_batch else accepted.hint("shuffle_hash")
    rejected = verdicts.filter("outcome <> 'accepted'").withColumnRenamed("outcome", "error")
    readable = named.filter(extension_allowed(F.col("title_document")) & size_allowed(F.col("size_bytes")))
    extracted = extract_text(readable.join(accepted, "upload_id", "left_semi"), pdf_decoder).drop("content")
    extracted = extracted.withColumn("chunk_texts", cutting_text(F.col("text"))).drop("text")
    extracted = extracted.withColumn("num_of_chunks", F.size("chunk_texts"))
    texts = materialise(extracted.unionByName(rejected, allowMissingColumns=True), "extracted")
    cut = texts.filter(F.col("error").isNull()).withColumn("document_id", document_id(texts))
    documents = cut.select(
        "document_id",
        "collection_id",
        "title",
        "title_document",
        minio_link(
            bucket_name(F.col("collection_id"), slug_lookup(F.col("collection_name"))), F.col("title_document")
        ).alias("minio_link"),
        F.to_date(now).alias("date_de_creation"),
        now.alias("created_at"),
        posted_by.alias("posted_by"),
        "num_of_chunks",
    )
    chunks = embed_chunks(
        _one_row_each(cut.select("document_id", "collection_id", "chunk_texts"), "chunk_texts"), encoder, partitions=embed_partitions
    ).withColumn("created_at", now)
    rejects = texts.filter(F.col("error").isNotNull())
    return Ingested(documents, chunks, rejects.select("upload_id", "title_document", F.col("error").alias("reason")))


def ingest_estimate(documents: DataFrame) -> DataFrame:
    """Planned seconds per document."""
    return documents.select("document_id", estimated_time(F.col("num_of_chunks")).alias("estimated_time"))
