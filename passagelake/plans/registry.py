"""Every operator as a query over the given tables.

Each entry takes ``(spark, sf_dir)``. The inputs are bound in
``passagelake.fixtures``; the matching SQL is in ``passagelake.plans.oracles``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.fixtures import DIM, Bindings
from passagelake.functions import extract, text, vectors
from passagelake.functions.encoders import HashingEncoder
from passagelake.operators import access, catalog, cells, guards, ids, knn, metrics, projections, quality, search, skew
from passagelake.plans import ingest
from passagelake.session import materialise, scratch_path, ship_package
from passagelake.sources import changes, files, objects, sinks, tables
from passagelake.streaming import ingest as streaming_ingest
from passagelake.streaming import metrics as streaming_metrics

Query = Callable[[SparkSession, str], DataFrame]

# Stand-ins for "now" and for the parameters a caller would give.
NOW = "TIMESTAMP_NTZ '2025-01-01 08:00:00'"
SESSION_TIME = "TIMESTAMP_NTZ '2024-01-15 12:00:00'"
SIZE_BOUNDS = [1e4, 1e5, 5e5, 1_048_576.0, 2e6, 5e6]
RUN_PARAMS = {"model_name": "hashing-encoder", "model_version": "1", "source": "batch search"}

_QUERIES: dict[str, Query] = {}


def query(build: Callable[[Bindings], DataFrame]) -> Callable[[Bindings], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(Bindings(spark, sf_dir))

    _QUERIES[build.__name__] = run
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _now():
    return F.expr(NOW)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- scans, sources, sinks -------------------------------------------------


@query
def scan_table(t: Bindings) -> DataFrame:
    return tables.scan_table(t.spark, f"{t.sf_dir}/events.parquet")


def _arrivals(t: Bindings, root: str) -> str:
    """All documents as text files that have arrived, one folder for each source."""
    folder = f"{root}/arrivals"
    t["documents"].select("source", "text").write.partitionBy("source").option("maxRecordsPerFile", 20).text(folder)
    return folder


def _source_of(path: Column) -> Column:
    return F.regexp_extract(path, "source=(src[0-9]+)", 1)


@query
def scan_files(t: Bindings) -> DataFrame:
    """Arrived files of bounded size with their contents: bytes listed and bytes read for each source."""
    folder = _arrivals(t, scratch_path(t.spark, "files"))
    found = files.scan_files(t.spark, folder, glob="*.txt", max_bytes=1 << 30)
    return found.groupBy(_source_of(F.col("path")).alias("source")).agg(
        F.sum("length").alias("n_bytes"), F.sum(F.length("content").cast("long")).alias("n_read")
    )


def _stored(t: Bindings) -> str:
    """All documents put into an object store, keyed as on update."""
    store = scratch_path(t.spark, "objects")
    collection = (F.substring("source", 4, 9).cast("int") + 1).cast("string")
    objects.put_objects(
        t["documents"].select(
            F.concat(F.lit("collection-"), collection, F.lit("-"), "source").alias("bucket"),
            F.concat(F.lit("Doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("object_name"),
            F.encode("text", "utf-8").alias("content"),
        ),
        store, "bulk",
    )
    return store


@query
def object_manifest(t: Bindings) -> DataFrame:
    return objects.manifest(t.spark, _stored(t))


@query
def put_objects(t: Bindings) -> DataFrame:
    """Stored contents, read back."""
    found = objects.stored_objects(t.spark, _stored(t))
    return found.select(
        F.element_at(F.split("bucket", "-"), 2).cast("int").alias("collection_id"), F.col("object_name").alias("title_document"),
        F.length("content").cast("long").alias("size_bytes"),
    )


@query
def move_objects(t: Bindings) -> DataFrame:
    """What the store holds after the objects of renamed collections have moved."""
    store = _stored(t)
    objects.move_objects(t.spark, store, _renamed(t), "renames")
    return objects.manifest(t.spark, store)


# Extensions of the uploads in turn, and how often an upload is repeated, takes the title of a stored
# document, is too large, or is damaged.
UPLOAD_KINDS = ("txt", "html", "docx", "pdf", "TXT", "csv", "docx", "html")
REPEATED, RETITLED, OVERSIZED, BAD_TEXT, BAD_DOCX = 10, 13, 997, 41, 43


def _files_of_documents(t: Bindings) -> DataFrame:
    """Documents as uploads with real contents, stored as files arriving would be.

    Most have a title of their own; some come twice or under the title of a stored document, and some are too large,
    of a kind that is not accepted, or damaged.
    """
    doc_id = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, UPLOAD_KINDS)), (doc_id % len(UPLOAD_KINDS) + 1).cast("int"))
    text_bytes = lambda text: F.concat(F.encode(text, "utf-8"), F.when(doc_id % BAD_TEXT == 0, F.lit(b"\xff")).otherwise(F.lit(b"")))
    docx = _docx_file(F.when(kind == "docx", F.col("text")))
    body = (
        F.when(doc_id % OVERSIZED == 0, F.encode(F.rpad("text", 1_048_577, "x"), "utf-8"))
        .when(kind == "html", text_bytes(F.concat(F.lit("<p>"), F.replace("text", F.lit("<"), F.lit(" ")), F.lit("</p>"))))
        .when(kind == "docx", F.when(doc_id % BAD_DOCX == 0, F.substring(docx, 1, 20)).otherwise(docx))
        .otherwise(text_bytes(F.col("text")))
    )
    title = F.concat(F.when(doc_id % RETITLED == 0, "Doc ").otherwise("Upload "), doc_id.cast("string"))
    uploads = t.spread("documents", "doc_id").select(
        "doc_id",
        (F.substring("source", 4, 9).cast("int") + 1).alias("collection_id"),
        F.col("source").alias("collection_name"),
        title.alias("title"),
        F.concat(title, F.lit("."), kind).alias("filename"),
        body.alias("content"),
    )
    times = F.when(doc_id % REPEATED == 0, 2).otherwise(1)
    uploads = uploads.select("*", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy"))
    uploads = uploads.withColumn("upload_id", doc_id * 2 + F.col("copy")).withColumn("arrival", F.col("upload_id"))
    return materialise(uploads.drop("doc_id", "copy").withColumn("size_bytes", F.length("content").cast("long")), "uploads")


@F.arrow_udf(T.BinaryType())
def _docx_file(texts: pa.Array) -> pa.Array:
    """A minimal docx file with one paragraph per line, as input for the extraction."""
    control = {i: " " for i in range(32) if i != 10}

    def build(body: str) -> bytes:
        paragraphs = "".join(
            f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'
            for line in body.translate(control).split("\n")
        )
        target = io.BytesIO()
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(
                "word/document.xml",
                '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
                f"<w:body>{paragraphs}</w:body></w:document>",
            )
        return target.getvalue()

    return pa.array([None if body is None else build(body) for body in texts.to_pylist()], pa.binary())


def _ingested(t: Bindings):
    return ingest.ingest(_files_of_documents(t), t["v_documents"], _now(), F.lit("loader"), HashingEncoder(DIM))


@query
def sink_documents_chunks(t: Bindings) -> DataFrame:
    """Full ingest written to both tables and read back: stored count, actual rows, characters."""
    root = scratch_path(t.spark, "ingested")
    result = _ingested(t)
    sinks.sink_documents_chunks(result.documents, result.chunks, root, "bulk", batch_id=0)
    chunks = t.spark.read.parquet(f"{root}/chunks").groupBy("document_id").agg(
        F.count("*").alias("n_chunks"), F.sum("taille_chunk").alias("n_chars")
    )
    documents = t.spark.read.parquet(f"{root}/documents")
    return documents.join(chunks, "document_id", "left").select(
        "document_id", "collection_id", "title_document", "num_of_chunks",
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
    )


@query
def ingest_quarantine(t: Bindings) -> DataFrame:
    return _ingested(t).quarantine


@query
def seed_roles(t: Bindings) -> DataFrame:
    return access.seed_roles(t["v_custom_roles"])


@query
def seed_admin(t: Bindings) -> DataFrame:
    return access.seed_admin(t["v_users"], "hashed", _now()).select("user_id", "username", "email", "role_id")


@query
def constraint_violations(t: Bindings) -> DataFrame:
    reports = [
        quality.constraint_violations(t[f"v_{table}"], table)
        for table in ("roles", "users", "collections", "documents", "chunks")
    ]
    return reduce(DataFrame.unionByName, reports)


@query
def search_log_sink(t: Bindings) -> DataFrame:
    path = scratch_path(t.spark, "search-log")
    sinks.search_log_sink(_search_metrics(t), path, "run-1")
    return _shown(t.spark.read.parquet(path).select("run_id", "query_id", "kind", "key", "value"))


# --- projections -----------------------------------------------------------


@query
def list_users(t: Bindings) -> DataFrame:
    return projections.list_users(t["v_users"])


@query
def list_roles_summary(t: Bindings) -> DataFrame:
    return projections.list_roles_summary(t["v_roles"])


@query
def list_collections(t: Bindings) -> DataFrame:
    return projections.list_collections(t["v_collections"])


@query
def list_documents(t: Bindings) -> DataFrame:
    return projections.list_documents(t["v_documents"], t["v_collections"])


@query
def minio_link(t: Bindings) -> DataFrame:
    named = projections.documents_with_collection_name(t["v_documents"], t["v_collections"])
    bucket = text.bucket_name(F.col("collection_id"), text.slug_lookup(F.col("collection_name")))
    return named.select("document_id", text.minio_link(bucket, F.col("title_document")).alias("minio_link"))


# --- filters and guards ----------------------------------------------------


@query
def get_by_id(t: Bindings) -> DataFrame:
    wanted = t["events"].select((F.col("user_id") * 11).cast("int").alias("user_id"))
    found = projections.get_by_ids(t["v_users"], "user_id", wanted)
    return found.select("user_id", "username", "email", "role_id", "found")


@query
def get_documents_by_collection(t: Bindings) -> DataFrame:
    names = t["part"].select(F.concat(F.lit("src"), F.col("p_size").cast("string")).alias("name"))
    return projections.get_documents_by_collection(t["v_documents"], t["v_collections"], names)


@query
def optional_collection_filter(t: Bindings) -> DataFrame:
    return t["v_queries"].select("query_id", text.optional_filter(F.col("filtre")).alias("filtre"))


@query
def extension_whitelist(t: Bindings) -> DataFrame:
    return guards.extension_whitelist(t["v_uploads"]).select(
        "upload_id", "filename", text.file_extension(F.col("filename")).alias("extension")
    )


@query
def size_gate(t: Bindings) -> DataFrame:
    return guards.size_gate(t["v_uploads"]).select("upload_id", "size_bytes")


@query
def guard_duplicate_document(t: Bindings) -> DataFrame:
    return guards.guard_duplicate_document(t["v_uploads"], t["v_documents"]).select(
        "upload_id", "collection_id", "title_document"
    )


@query
def guard_duplicate_collection(t: Bindings) -> DataFrame:
    return guards.guard_duplicate_collection(t["v_new_collections"], t["v_collections"])


@query
def guard_duplicate_username(t: Bindings) -> DataFrame:
    return guards.guard_duplicate_username(t["v_new_users"], t["v_users"]).select("seq", "username")


@query
def upload_gate_outcome(t: Bindings) -> DataFrame:
    return guards.upload_gate_outcome(t["v_uploads"], t["v_documents"]).select(
        "upload_id", "collection_id", "title_document", "outcome"
    )


@query
def null_embedding_filter(t: Bindings) -> DataFrame:
    return search.null_embedding_filter(t["v_vectors"], DIM).select("chunk_id", F.size("embedding").alias("dim"))


# --- joins -----------------------------------------------------------------


@query
def join_chunks_documents(t: Bindings) -> DataFrame:
    return search.join_chunks_documents(t["v_chunks"], t["v_documents"]).select(
        "chunk_id", "document_id", "collection_id", "chunk_text"
    )


@query
def join_chunks_documents_collections(t: Bindings) -> DataFrame:
    return search.join_chunks_documents_collections(t["v_chunks"], t["v_documents"], t["v_collections"]).select(
        "chunk_id", "document_id", "collection_name"
    )


@query
def documents_with_collection_name(t: Bindings) -> DataFrame:
    return projections.documents_with_collection_name(t["v_documents"], t["v_collections"]).select(
        "document_id", "collection_name"
    )


@query
def users_with_role(t: Bindings) -> DataFrame:
    return access.users_with_role(t["v_users"], t["v_roles"])


@query
def documents_of_collections(t: Bindings) -> DataFrame:
    return projections.documents_of_collections(t["v_documents"], t["v_dropped_collections"]).select(
        "document_id", "collection_id"
    )


def _candidates(t: Bindings):
    return search.candidates(t["v_chunks"], t["v_documents"], t["v_collections"], DIM)


@query
def query_corpus_join(t: Bindings) -> DataFrame:
    profile = knn.distance_profile(t["v_queries"], _candidates(t), DIM)
    return _rounded(profile, "min_distance", "mean_distance", "max_distance")


@query
def fk_violations(t: Bindings) -> DataFrame:
    return quality.fk_violations(
        {table: t[f"v_{table}"] for table in ("roles", "users", "collections", "documents", "chunks")}
    )


# --- search and its metrics ------------------------------------------------


def _centroid(t: Bindings) -> list[float]:
    """Mean of all vectors as the vector of a single request."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return t["embeddings"].agg(vector_to_array(mean).alias("v")).first()["v"]


def _single(t: Bindings, **request) -> DataFrame:
    hits = search.search(
        _centroid(t), t["v_chunks"], t["v_documents"], t["v_collections"], dim=DIM, **request
    )
    return _rounded(hits, "distance", "cos").select("rk", "chunk_id", "document_id", "distance", "cos")


def _laid_out(t: Bindings) -> str:
    """Documents and their chunks as the ingest stores them."""
    root = scratch_path(t.spark, "laid-out")
    chunks = search.join_chunks_documents(t["v_chunks"], t["v_documents"])
    sinks.sink_documents_chunks(t["v_documents"], chunks, root, "bulk", 0)
    return root


def _hits(t: Bindings) -> DataFrame:
    return search.topk_search_batch(t["v_queries"], t["v_chunks"], t["v_documents"], t["v_collections"], DIM)


def _search_metrics(t: Bindings) -> DataFrame:
    return search.search_metrics_long(_hits(t), t["v_queries"], RUN_PARAMS)


def _shown(logged: DataFrame) -> DataFrame:
    """Metric values with six decimals."""
    metric = F.format_string("%.6f", F.col("value").try_cast("double"))
    return logged.withColumn("value", F.when(F.col("kind") == "metric", metric).otherwise(F.col("value")))


@query
def topk_search_all(t: Bindings) -> DataFrame:
    return _single(t, top_n=10)


@query
def topk_search_collection(t: Bindings) -> DataFrame:
    """On the stored layout: only the folders of the collection are read."""
    chunks = t.spark.read.parquet(f"{_laid_out(t)}/chunks")
    hits = search.search(
        _centroid(t), chunks, t["v_documents"], t["v_collections"], top_n=10, filtre="src3", dim=DIM, placed=True
    )
    return _rounded(hits, "distance", "cos").select("rk", "chunk_id", "document_id", "distance", "cos")


@query
def topk_search_batch(t: Bindings) -> DataFrame:
    return _rounded(_hits(t), "distance", "cos")


@query
def topk_search_unlimited(t: Bindings) -> DataFrame:
    """Searches without limit and with a very large one, ranked by ranges."""
    hits = search.topk_search_batch(t["v_wide_queries"], t["v_chunks"], t["v_documents"], t["v_collections"], DIM)
    return _rounded(hits, "distance", "cos")


@query
def topk_search_cells(t: Bindings) -> DataFrame:
    """All vectors searched over stored cells, of which those that cannot hold a hit are not read."""
    path = scratch_path(t.spark, "cells")
    cells.store_cells(_candidates(t)({None}), path, DIM)
    return _rounded(cells.search_cells(t["v_queries"], path, DIM).hits, "distance", "cos")


@query
def rank_per_query(t: Bindings) -> DataFrame:
    return _hits(t).select("query_id", "rk", "chunk_id")


@query
def knn_vectorised(t: Bindings) -> DataFrame:
    """The same search with a broadcast budget far below the queries, so several blocks run."""
    hits = search.topk_search_batch(
        t["v_queries"], t["v_chunks"], t["v_documents"], t["v_collections"], DIM, block_bytes=128 << 10
    )
    return _rounded(hits, "distance", "cos")


@query
def search_result_shape(t: Bindings) -> DataFrame:
    return _rounded(search.search_result_shape(_hits(t), t["v_chunks"], t["v_queries"]), "distance")


@query
def search_response_nested(t: Bindings) -> DataFrame:
    shaped = search.search_result_shape(_hits(t), t["v_chunks"], t["v_queries"])
    nested = search.search_response_nested(shaped)
    return nested.select(
        "query_id",
        F.size("results").alias("n_results"),
        F.array_join(F.transform("results", lambda hit: hit["chunk_id"].cast("string")), ",").alias("chunk_ids"),
    )


@query
def mean_cos_similarity(t: Bindings) -> DataFrame:
    return _rounded(search.mean_cos_similarity(_hits(t)), "mean_cos_similarity")


@query
def cos_similarity_top_i(t: Bindings) -> DataFrame:
    most = t["v_queries"].agg(F.max("top_n")).first()[0]
    wide = search.cos_similarity_top_i(_hits(t), most or 0)
    return _rounded(wide, *[c for c in wide.columns if c != "query_id"])


@query
def search_metrics_long(t: Bindings) -> DataFrame:
    return _shown(_search_metrics(t))


# --- aggregations ----------------------------------------------------------


def _cut(t: Bindings) -> DataFrame:
    return ingest.explode_chunks(t.spread("documents", "doc_id").select(F.col("doc_id").alias("document_id"), "text"))


@query
def count_chunks_per_document(t: Bindings) -> DataFrame:
    return t["documents"].select("doc_id", text.count_chunks(F.col("text")).alias("num_of_chunks"))


@query
def stored_chunk_count_check(t: Bindings) -> DataFrame:
    return quality.stored_chunk_count_check(t["v_documents"], _cut(t))


@query
def upload_counters(t: Bindings) -> DataFrame:
    counted = t["documents"].select(text.count_chunks(F.col("text")).alias("num_of_chunks"))
    return metrics.upload_counters(counted)


@query
def upload_size_histogram(t: Bindings) -> DataFrame:
    judged = guards.upload_gate_outcome(t["v_uploads"], t["v_documents"])
    return metrics.upload_size_histogram(judged, SIZE_BOUNDS)


@query
def upload_time_histogram(t: Bindings) -> DataFrame:
    return _rounded(metrics.upload_time_histogram(t["v_requests"], "value", F.col("username") != "ghost"), "total_sum")


@query
def mean_pool(t: Bindings) -> DataFrame:
    pooled = vectors.mean_pool(t["embeddings"], "label", "embedding")
    return _rounded(pooled.select("label", F.posexplode("embedding").alias("pos", "mean")), "mean")


@query
def latest_version(t: Bindings) -> DataFrame:
    return projections.latest_version(t["v_model_versions"])


@query
def next_id(t: Bindings) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            projections.next_id(t[view], key).withColumn("table_name", F.lit(view))
            for view, key in (("v_users", "user_id"), ("v_collections", "collection_id"), ("v_documents", "document_id"))
        ],
    )


@query
def first_wins_in_batch(t: Bindings) -> DataFrame:
    return guards.first_wins_in_batch(t["v_uploads"])


@query
def assign_ids(t: Bindings) -> DataFrame:
    keys = _cut(t).select("document_id", "chunk_index")
    return ids.assign_ids(keys, ["document_id", "chunk_index"], "chunk_id", after=1000)


@query
def first_row(t: Bindings) -> DataFrame:
    return projections.first_row(t["v_collections"], ["name"], "collection_id").select("name", "collection_id", "user_id")


# --- vectors and embedding -------------------------------------------------


def _to_centroid(t: Bindings) -> DataFrame:
    pooled = vectors.mean_pool(t["embeddings"], "label", "embedding").withColumnRenamed("embedding", "centroid")
    return skew.spread_join(t["embeddings"], pooled, ["label"], "vec_id", "inner")


@query
def l2_distance(t: Bindings) -> DataFrame:
    measured = _to_centroid(t).select(
        "vec_id", "label", vectors.l2_distance(F.col("embedding"), F.col("centroid")).alias("distance")
    )
    return _rounded(measured, "distance")


@query
def cosine_similarity(t: Bindings) -> DataFrame:
    measured = _to_centroid(t).select(
        "vec_id", "label", vectors.cosine_similarity(F.col("embedding"), F.col("centroid")).alias("cos")
    )
    return _rounded(measured, "cos")


def _answers(t: Bindings) -> DataFrame:
    """Similarity of each assistant turn to the first user turn of its conversation."""
    turns = t["conversations"]
    questions = projections.first_row(turns.filter("role = 'user'"), ["conv_id"], "turn")
    encoder = HashingEncoder(DIM)
    return search.pairwise_cosine(
        ingest.embed_queries(questions, encoder, "text").select("conv_id", "embedding"),
        ingest.embed_queries(turns.filter("role = 'assistant'"), encoder, "text").select("conv_id", "turn", "embedding"),
        "conv_id",
        "turn",
    )


@query
def pairwise_cosine(t: Bindings) -> DataFrame:
    return _rounded(_answers(t), "cos")


@query
def pairwise_cosine_mean(t: Bindings) -> DataFrame:
    return _rounded(_answers(t).groupBy("conv_id").agg(F.avg("cos").alias("mean_cos")), "mean_cos")


@query
def vector_dim_check(t: Bindings) -> DataFrame:
    return quality.vector_dim_check(t["v_vectors"], "embedding", DIM).select("chunk_id", "dim_verdict")


def _slots(df: DataFrame, *key: str) -> DataFrame:
    """Non-zero vector elements, one row each."""
    cells = df.select(*key, F.posexplode("embedding").alias("slot", "weight"))
    return cells.filter("weight <> 0").withColumn("weight", F.col("weight").cast("int"))


@query
def embed_chunks(t: Bindings) -> DataFrame:
    return _slots(ingest.embed_chunks(_cut(t), HashingEncoder(DIM)), "document_id", "chunk_index")


@query
def embed_queries(t: Bindings) -> DataFrame:
    return _slots(ingest.embed_queries(t["benchmark"], HashingEncoder(DIM), "text"), "item_id")


@query
def encoder(t: Bindings) -> DataFrame:
    """A user's own encoder, here one that returns text measures, plugged into the same function."""
    return ingest.embed_queries(t["conversations"], text_measures, "text").select(
        "conv_id", "turn", F.element_at("embedding", 1).cast("int").alias("n_chars"),
        F.element_at("embedding", 2).cast("int").alias("n_words"),
    )


def text_measures():
    import numpy as np

    return lambda texts: np.array([(len(x), len(x.split())) for x in texts], np.float32)


@query
def search_texts(t: Bindings) -> DataFrame:
    """Text search end to end: cut and embed all documents, embed all questions, nearest five chunks each."""
    encoder = HashingEncoder(DIM)
    numbered = ids.assign_ids(_cut(t), ["document_id", "chunk_index"], "chunk_id")
    chunks = ingest.embed_chunks(numbered, encoder)
    asked = ingest.embed_queries(t["benchmark"], encoder, "text").select(
        F.col("item_id").alias("query_id"), "embedding", F.lit(search.DEFAULT_TOP_N).alias("top_n"),
        F.lit(None).cast("string").alias("filtre"),
    )
    hits = search.topk_search_batch(asked, chunks, t["v_documents"], t["v_collections"], DIM)
    return _rounded(hits, "distance", "cos")


# --- text ------------------------------------------------------------------


@query
def extract_txt(t: Bindings) -> DataFrame:
    """Texts as bytes, every tenth cut inside a character or spoiled; NULL where not valid UTF-8."""
    content = F.when(F.col("doc_id") % 10 == 0, F.concat(F.encode("text", "utf-8"), F.lit(b"\xff"))).otherwise(
        F.encode("text", "utf-8")
    )
    decoded = extract.extract_txt(content)
    return t["documents"].select("doc_id", F.length(decoded).alias("n_chars"), F.md5(decoded).alias("digest"))


@query
def extract_html(t: Bindings) -> DataFrame:
    pages = extract.extract_html(t.spread("pages", "page_id").select("page_id", "html"), "html")
    words = F.array_join(text.split_words(F.col("text")), " ")
    return pages.select("page_id", words.alias("words")).select(
        "page_id", F.length("words").alias("n_chars"), F.md5("words").alias("digest")
    )


@query
def extract_docx(t: Bindings) -> DataFrame:
    words = F.array_join(text.split_words(extract.extract_docx(F.col("content"))), " ")
    made = t.spread("documents", "doc_id").select("doc_id", _docx_file(F.col("text")).alias("content"))
    return made.select("doc_id", F.md5(words).alias("digest"))


@query
def extract_text(t: Bindings) -> DataFrame:
    uploads = _files_of_documents(t).withColumn("title_document", text.normalize_filename(F.col("filename")))
    extracted = extract.extract_text(uploads.select("upload_id", "title_document", "content"))
    return extracted.select("upload_id", F.size(text.split_words(F.col("text"))).alias("n_words"), "error")


@query
def split_words(t: Bindings) -> DataFrame:
    words = text.split_words(F.col("text"))
    return t["documents"].select("doc_id", F.size(words).alias("n_words"), F.md5(F.array_join(words, "|")).alias("digest"))


@query
def cutting_text(t: Bindings) -> DataFrame:
    return _cut(t).select("document_id", "chunk_index", F.md5("chunk_text").alias("digest"))


@query
def taille_chunk(t: Bindings) -> DataFrame:
    return _cut(t).select("document_id", "chunk_index", "taille_chunk")


@query
def slug_create(t: Bindings) -> DataFrame:
    return t["v_new_collections"].select("seq", text.slug_create(F.col("name")).alias("slug"))


@query
def slug_update(t: Bindings) -> DataFrame:
    return t["v_collections"].select("collection_id", text.slug_update(F.col("name")).alias("slug"))


@query
def slug_lookup(t: Bindings) -> DataFrame:
    return t["v_collections"].select("collection_id", text.slug_lookup(F.col("name")).alias("slug"))


@query
def bucket_name(t: Bindings) -> DataFrame:
    bucket = text.bucket_name(F.col("collection_id"), text.slug_lookup(F.col("name")))
    return t["v_collections"].select("collection_id", bucket.alias("bucket"))


@query
def bucket_key_drift(t: Bindings) -> DataFrame:
    return catalog.bucket_key_drift(t["v_collections"])


@query
def normalize_filename(t: Bindings) -> DataFrame:
    return t["v_uploads"].select("upload_id", text.normalize_filename(F.col("filename")).alias("title_document"))


@query
def estimated_time(t: Bindings) -> DataFrame:
    return t["documents"].select("doc_id", text.estimated_time(text.count_chunks(F.col("text"))).alias("estimated_time"))


@query
def execution_time_fmt(t: Bindings) -> DataFrame:
    return t["events"].select("event_id", text.execution_time_fmt(F.col("value")).alias("execution_time"))


@query
def permission_message(t: Bindings) -> DataFrame:
    refused = access.roles_unpivot(t["v_roles"]).filter("NOT granted")
    return refused.select("role_id", "required_grant", text.permission_message(F.col("required_grant")).alias("message"))


@query
def token_expiry(t: Bindings) -> DataFrame:
    expiry = text.token_expiry(F.col("ts"))
    return t["v_requests"].select(
        "event_id", "username", expiry.alias("expires_at"),
        ((F.col("ts") <= F.expr(SESSION_TIME)) & (expiry > F.expr(SESSION_TIME))).alias("valid"),
    )


@query
def creation_stamps(t: Bindings) -> DataFrame:
    return t["v_requests"].select("event_id", *text.creation_stamps(F.col("ts")))


# --- catalog changes -------------------------------------------------------


@query
def create_users(t: Bindings) -> DataFrame:
    return catalog.create_users(t["v_new_users"], t["v_users"], _now())


@query
def update_users(t: Bindings) -> DataFrame:
    return catalog.update_users(t["v_users"], t["v_user_changes"]).select("user_id", "username", "email", "role_id")


@query
def duplicate_usernames(t: Bindings) -> DataFrame:
    return quality.duplicate_usernames(t["v_new_users"])


@query
def delete_users(t: Bindings) -> DataFrame:
    return catalog.delete_users(t["v_users"], t["v_dropped_users"], t["v_collections"]).select("user_id")


@query
def blocked_user_deletes(t: Bindings) -> DataFrame:
    return catalog.blocked_user_deletes(t["v_users"], t["v_dropped_users"], t["v_collections"])


@query
def create_collections(t: Bindings) -> DataFrame:
    return catalog.create_collections(t["v_new_collections"], t["v_collections"], _now(), t["v_objects"])


@query
def update_collections(t: Bindings) -> DataFrame:
    return catalog.update_collections(t["v_collections"], t["v_collection_changes"], _now())


def _renamed(t: Bindings) -> DataFrame:
    after = catalog.update_collections(t["v_collections"], t["v_collection_changes"], _now())
    return catalog.renamed_buckets(t["v_collections"], after)


@query
def rekey_objects(t: Bindings) -> DataFrame:
    return catalog.rekey_objects(t["v_objects"], _renamed(t))


@query
def apply_rekey(t: Bindings) -> DataFrame:
    return catalog.apply_rekey(t["v_objects"], _renamed(t)).select("bucket", "object_name")


def _remaining(name: str, df: DataFrame, key: str) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("id"))


@query
def delete_collections_cascade(t: Bindings) -> DataFrame:
    collections, documents, chunks = catalog.delete_collections_cascade(
        t["v_dropped_collections"], t["v_collections"], t["v_documents"], t["v_chunks"]
    )
    return (
        _remaining("collections", collections, "collection_id")
        .unionByName(_remaining("documents", documents, "document_id"))
        .unionByName(_remaining("chunks", chunks, "chunk_id"))
    )


@query
def delete_documents_cascade(t: Bindings) -> DataFrame:
    documents, chunks, _ = catalog.delete_documents_cascade(
        t["v_dropped_documents"], t["v_documents"], t["v_chunks"], t["v_collections"]
    )
    return _remaining("documents", documents, "document_id").unionByName(_remaining("chunks", chunks, "chunk_id"))


@query
def delete_stored_documents(t: Bindings) -> DataFrame:
    """Deletes on stored tables, which rewrite the touched folders."""
    root = _laid_out(t)
    changes.delete_documents(t.spark, root, t["v_dropped_documents"])
    documents, chunks = (t.spark.read.parquet(f"{root}/{name}") for name in ("documents", "chunks"))
    return _remaining("documents", documents, "document_id").unionByName(_remaining("chunks", chunks, "chunk_id"))


@query
def deleted_objects(t: Bindings) -> DataFrame:
    return catalog.delete_documents_cascade(
        t["v_dropped_documents"], t["v_documents"], t["v_chunks"], t["v_collections"]
    )[2]


# --- streaming -------------------------------------------------------------


@query
def stream_upload_metrics(t: Bindings) -> DataFrame:
    """The request log replayed as a stream; windows the watermark has closed."""
    source = t["events"]
    replay = streaming_metrics.replay(t.spark, source.schema, f"{t.sf_dir}/events.parquet")
    path = scratch_path(t.spark, "upload-metrics")
    streaming_metrics.stream_upload_metrics(replay, path, path + "-checkpoint").awaitTermination()
    closed = t.spark.read.schema(streaming_metrics.upload_metrics(source).schema).parquet(path)
    return _rounded(closed, "total_seconds").withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )


@query
def upload_metrics_by_window(t: Bindings) -> DataFrame:
    return _rounded(streaming_metrics.upload_metrics(t["events"]), "total_seconds")


@query
def stream_ingest(t: Bindings) -> DataFrame:
    """All documents as arriving text files, ingested as a stream; words stored per collection."""
    root = scratch_path(t.spark, "stream")
    folder = _arrivals(t, root)

    def to_uploads(arrived: DataFrame) -> DataFrame:
        source = _source_of(F.col("path"))
        return arrived.select(
            F.xxhash64("path").alias("upload_id"), F.unix_micros("modificationTime").alias("arrival"),
            (F.substring(source, 4, 9).cast("int") + 1).alias("collection_id"), source.alias("collection_name"),
            files.file_name(F.col("path")).alias("title"), files.file_name(F.col("path")).alias("filename"),
            F.col("length").alias("size_bytes"), "content",
        )

    with streaming_ingest.listed_by_cores(t.spark):
        streaming_ingest.stream_ingest(
            t.spark, folder, f"{root}/tables", f"{root}/_checkpoint", to_uploads, _now(), F.lit("loader"),
            HashingEncoder(DIM), files_per_batch=400,
        ).awaitTermination()
    stored = t.spark.read.parquet(f"{root}/tables/chunks")
    return stored.groupBy("collection_id").agg(F.sum(F.size(F.split("chunk_text", " "))).cast("long").alias("n_words"))


# --- access rules ----------------------------------------------------------


@query
def roles_unpivot(t: Bindings) -> DataFrame:
    return access.roles_unpivot(t["v_roles"])


@query
def check_permission(t: Bindings) -> DataFrame:
    judged = access.check_permission(t["v_requests"], t["v_users"], t["v_roles"], t["v_endpoints"])
    return judged.select("event_id", "username", "role_id", "endpoint", "outcome", "message")


@query
def endpoint_permission_map(t: Bindings) -> DataFrame:
    return access.endpoint_usage(t["v_requests"], t["v_endpoints"])


@query
def access_audit(t: Bindings) -> DataFrame:
    return access.access_audit(t["v_requests"], t["v_users"], t["v_roles"], t["v_endpoints"])


@query
def unused_grants(t: Bindings) -> DataFrame:
    return access.unused_grants(t["v_roles"], t["v_endpoints"])
