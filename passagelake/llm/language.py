"""Language identification by fusing evidence from the text, the markup, the address and the host.

For a row with text ``x``, declared language ``d``, address suffix ``s`` and host ``h`` the score of language ``l`` is

    n_eff * mean ln P(trigram | l)  +  ln P(d | l)  +  ln P(s | l)  +  ln P(l | h)

with evidence left out where it is missing. The trigram model is fitted on a bounded sample of labelled
documents. Its answers over all rows then give, by grouped aggregation, how often rows of a language declare each
language, how its suffixes are distributed, and the languages of every host, which are smoothed towards those of its
domain, of its suffix and of the whole table in turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelake.llm.common import let, map_batches, slices
from passagelake.llm.html_text import main_text
from passagelake.session import materialise

#: Labelled documents that the trigram model is fitted on, for each language at most.
SAMPLE = 400
#: Languages of the model at most, those with the most sampled documents (ties by name): 64 MB of model.
LANGUAGES = 512
#: Buckets that byte trigrams are hashed into; the model has this many numbers for each language.
BUCKETS = 1 << 14
#: A text of n trigrams counts as n * WEIGHT / (n + WEIGHT): neighbouring trigrams are not independent.
WEIGHT = 60.0
#: Pseudo-counts: of a language among declarations and suffixes, and of the wider level in a host's languages.
SMOOTH = 1.0
HOST_SMOOTH = 5.0

_DECLARED = re.compile(r"<html\b[^>]{0,2000}?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.IGNORECASE)


def _buckets(text: str) -> np.ndarray:
    """Bucket of every trigram of the lower-cased UTF-8 bytes, white space runs being one space."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    mixed = (data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA6B) ^ data[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    return mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)


@dataclass(frozen=True)
class Model:
    """``logs[l, bucket]`` is ln P(trigram | language)."""

    languages: tuple[str, ...]
    logs: np.ndarray

    def scores(self, text: str) -> list[float]:
        found = _buckets(text)
        if not len(found):
            return [0.0] * len(self.languages)
        weight = WEIGHT / (len(found) + WEIGHT)
        return (self.logs[:, found].sum(axis=1) * weight).tolist()


def primary(code: Column) -> Column:
    """Primary subtag of a language code, null if it is none."""
    found = F.regexp_extract(F.lower(code), r"^\s*([a-z]{2,3})(?:[^a-z]|$)", 1)
    return F.when(found != "", found)


def fit(labelled: DataFrame) -> Model:
    """Trigram model from ``SAMPLE`` documents of each language, the first ones by a hash of their id and length
    (rows that tie with the last one are taken too).

    Needs ``doc_id, text, lang``; rows without text or with no valid code are left out. What reaches the driver
    is an array of ``BUCKETS`` counts for each of at most ``LANGUAGES`` languages.
    """
    order = F.xxhash64("doc_id", F.length("text"))
    rows = labelled.select(primary(F.col("lang")).alias("lang"), "text", order.alias("_order")).where("lang is not null and text is not null")
    # The texts are read again by the last hash of each language's sample, so none of them is shuffled.
    ranked = rows.select("lang", "_order").withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_order")))
    limits = materialise(ranked.where(F.col("_n") <= SAMPLE).groupBy("lang").agg(F.max("_order").alias("_last"), F.count("*").alias("_docs")), "language-sample")
    limits = limits.orderBy(F.desc("_docs"), "lang").limit(LANGUAGES).select("lang", "_last")
    chosen = rows.join(F.broadcast(limits), "lang").where("_order <= _last")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                totals[lang] = totals.get(lang, 0) + np.bincount(_buckets(text), minlength=BUCKETS)
        for lang, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["lang", "bucket", "n"])

    counted = map_batches(chosen.select("lang", "text"), count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")).orderBy("lang").toArrow()
    counts = np.full((packed.num_rows, BUCKETS), 0.5)
    for row, buckets, ns in zip(counts, packed["buckets"], packed["ns"], strict=True):
        row[buckets.values.to_numpy()] += ns.values.to_numpy()
    return Model(tuple(packed["lang"].to_pylist()), np.log(counts / counts.sum(axis=1, keepdims=True)))


_SCORED = "doc_id long, page_id long, declared string, host string, scores array<double>"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Text scores of documents; their ``lang`` is what they declare and their ``source`` the host."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [shipped.value.scores(t or "") for t in batch.column("text").to_pylist()]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), none, batch.column("declared"), batch.column("host"), pa.array(scores, pa.list_(pa.float64()))], ["doc_id", "page_id", "declared", "host", "scores"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", primary(F.col("lang")).alias("declared"), F.col("source").alias("host"))
    return map_batches(rows, run, _SCORED)


def score_pages(pages: DataFrame, model: Model) -> DataFrame:
    """Text scores of the main text of pages, the language that the markup declares, and the host."""
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pages = [p or "" for p in batch.column("text").to_pylist()]
            declared = [m[1].lower() if (m := _DECLARED.search(p)) else None for p in pages]
            scores = [shipped.value.scores(main_text(p)) for p in pages]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, batch.column("page_id"), pa.array(declared, pa.string()), batch.column("host"), pa.array(scores, pa.list_(pa.float64()))], ["doc_id", "page_id", "declared", "host", "scores"])

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").cast("long"), F.col("html").alias("text"), F.when(host != "", host).alias("host"))
    return map_batches(rows, run, _SCORED)


def _softmax(scores: Column) -> Column:
    shifted = let(F.array_max(scores), lambda m: F.transform(scores, lambda s: F.exp(s - m)))
    return let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def _sums(count: int) -> Column:
    return F.array(*[F.sum(F.col("text_share")[k]) for k in range(count)])


def _total(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)


def _smoothed(own: Column, wider: Column) -> Column:
    """Shares of languages with ``HOST_SMOOTH`` rows of the wider level's shares added."""
    return let(_total(own), lambda n: F.zip_with(own, wider, lambda x, w: (x + HOST_SMOOTH * w) / (n + HOST_SMOOTH)))


def fuse(scored: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang``, ``confidence`` and ``text_lang`` to scored rows.

    Each evidence table is aggregated per task before it is shuffled and stored before it is joined, so Spark
    broadcasts it only if its stored size is small and otherwise splits hot keys.
    """
    n = len(model.languages)
    names = F.array(*[F.lit(x) for x in model.languages])
    label = F.col("host")
    suffix = F.when(label.contains("."), F.regexp_extract(label, r"([^.]+)\.?$", 1))
    domain = F.when(label.contains("."), F.regexp_extract(label, r"([^.]+\.[^.]+)\.?$", 1))
    rows = materialise(scored.withColumn("text_share", _softmax(F.col("scores"))).withColumn("suffix", suffix).withColumn("domain", domain), "language-scores")

    whole = rows.agg(_sums(n).alias("s")).first()["s"]
    whole = [x or 0.0 for x in whole]
    total = sum(whole) or 1.0
    overall = F.array(*[F.lit((x + 1.0 / n) / (total + 1.0)) for x in whole])
    sizes = F.array(*[F.lit(float(x)) for x in whole])

    def level(*keys: str) -> DataFrame:
        return rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(_sums(n).alias("own"))

    suffixes = materialise(level("suffix").withColumn("by_suffix", _smoothed(F.col("own"), overall)), "language-suffixes")
    domains = materialise(
        level("domain", "suffix").join(suffixes.select("suffix", "by_suffix"), "suffix", "left").select("domain", _smoothed(F.col("own"), F.coalesce("by_suffix", overall)).alias("by_domain")),
        "language-domains",
    )
    hosts = materialise(
        level("host", "domain").join(domains, "domain", "left").select("host", F.transform(_smoothed(F.col("own"), F.coalesce("by_domain", overall)), lambda x: F.ln(x)).alias("host_ln")),
        "language-hosts",
    )

    def given(key: str, alias: str) -> DataFrame:
        """ln P(value | language) of the values of a column, with SMOOTH pseudo-counts."""
        counted = level(key)
        values = counted.count() + 1
        shares = F.zip_with("own", sizes, lambda x, s: F.ln((x + SMOOTH) / (s + SMOOTH * values)))
        return materialise(counted.select(F.col(key), shares.alias(alias)), f"language-{key}")

    joined = (
        rows.join(hosts, "host", "left")
        .join(given("declared", "declared_ln"), "declared", "left")
        .join(given("suffix", "suffix_ln"), "suffix", "left")
    )
    nothing = F.array_repeat(F.lit(0.0), n)
    fused = F.zip_with(
        F.zip_with("scores", F.coalesce("host_ln", F.transform(overall, lambda x: F.ln(x))), lambda a, b: a + b),
        F.zip_with(F.coalesce("declared_ln", nothing), F.coalesce("suffix_ln", nothing), lambda a, b: a + b),
        lambda a, b: a + b,
    )
    return joined.withColumn("_share", _softmax(fused)).select(
        "doc_id", "page_id",
        F.get(names, F.array_position("_share", F.array_max("_share")).cast("int") - 1).alias("lang"),
        F.array_max("_share").alias("confidence"),
        F.get(names, F.array_position("text_share", F.array_max("text_share")).cast("int") - 1).alias("text_lang"),
        "declared", "host",
    )


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Language of every document and every page: ``doc_id`` or ``page_id``, ``lang``, ``confidence``, and evidence.

    Documents need ``doc_id, text, lang, source`` and pages ``page_id, url, html``; other columns are left out.
    Null or empty texts are judged by their other evidence alone. Without any labelled document the language
    is null. Ties go to the first language by name. Repeated rows give repeated results.
    """
    model = fit(docs)
    scored = score_documents(docs, model).unionAll(score_pages(pages, model))
    if not model.languages:
        return scored.select("doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    return fuse(scored, model)
