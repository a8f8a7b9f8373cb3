"""Passage search: candidates, single and batch requests, result shapes, metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelake.functions.text import optional_filter
from passagelake.functions.vectors import cosine_similarity, dim_ok
from passagelake.operators.knn import knn
from passagelake.operators.skew import spread_join
from passagelake.schema import COLLECTION_BUCKET, VECTOR_DIM, collection_bucket
from passagelake.session import materialise

# Hits per request by default, and the collection shown for an
# unfiltered search.
DEFAULT_TOP_N = 5
NO_COLLECTION = "Aucune collection"


# Rows of a narrow table that may be broadcast, after counting them.
BROADCAST_ROWS = 500_000
# Names that are compared in a filter, which reaches the file scan, and not in a join.
LISTED_NAMES = 1_000


def in_collections(chunks: DataFrame, collection_ids: list[int]) -> Column:
    """Chunks of these collections; on a table laid out in buckets a filter on the bucket folders too."""
    wanted = F.col("collection_id").isin(collection_ids)
    if COLLECTION_BUCKET in chunks.columns:
        wanted &= F.col(COLLECTION_BUCKET).isin(sorted({collection_bucket(i) for i in collection_ids}))
    return wanted


def null_embedding_filter(chunks: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Chunks that can be compared: a vector of ``dim`` numbers, none of them NULL."""
    return chunks.filter(dim_ok(F.col(vector), dim))


def join_chunks_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of existing documents; orphans of an unfinished ingest drop out."""
    return chunks.join(documents.select("document_id", "collection_id"), "document_id")


def join_chunks_documents_collections(
    chunks: DataFrame, documents: DataFrame, collections: DataFrame, how: str = "inner"
) -> DataFrame:
    """Chunks with the name of their collection.

    The two narrow tables are joined first, so the vectors meet one join only.
    """
    named = documents.select("document_id", "collection_id").join(
        collections.select("collection_id", F.col("name").alias("collection_name")), "collection_id", how
    )
    return chunks.join(named, "document_id")


def candidates(
    chunks: DataFrame, documents: DataFrame, collections: DataFrame, dim: int, placed: bool = False
) -> Callable[[set[str | None]], DataFrame]:
    """Chunks to compare, joined only as far as the requests need and without moving vectors if possible.

    The result takes the filters of a block of requests, None standing for no
    filter. Without a filtered request the collections are not read; with only
    filtered ones, just the chunks of the wanted collections remain.

    Whatever the size of the catalog, the document decides to which collection
    its chunks belong, and a document counts once, with its smallest collection
    id. In order of preference, the join with the documents is

    - a broadcast of the narrow document side, when it is counted to be small,
    - without filters a broadcast of the missing document ids, when those are few,
    - a shuffle join, which AQE splits where one document has very many chunks.

    ``placed`` says that the chunks carry the collection of their document, as
    tables of ``sinks.sink_documents_chunks`` do; the wanted collections, if they
    are few, then also reach the scan of the chunks, which skips other files.
    """

    known = documents.groupBy("document_id").agg(F.min("collection_id").alias("collection_id"))

    # asked once, however many blocks of queries are scanned
    @cache
    def few_documents() -> bool:
        return known.count() <= BROADCAST_ROWS

    @cache
    def few_collections() -> bool:
        return collections.count() <= BROADCAST_ROWS

    def named_collections(names: list[str]) -> DataFrame:
        """Collections of these names."""
        wanted = collections.select("collection_id", F.col("name").alias("collection_name"))
        if len(names) <= LISTED_NAMES:
            wanted = wanted.filter(F.col("collection_name").isin(names))
        else:
            listed = collections.sparkSession.createDataFrame([(name,) for name in names], "collection_name string")
            wanted = wanted.join(listed, "collection_name", "left_semi").select("collection_id", "collection_name")
        few = few_collections() or wanted.count() <= BROADCAST_ROWS
        return F.broadcast(wanted) if few else wanted

    @cache
    def missing_documents() -> DataFrame | None:
        missing = materialise(
            chunks.select("document_id").distinct().join(known, "document_id", "left_anti"), "missing-documents"
        )
        return missing if missing.count() <= BROADCAST_ROWS else None

    def build(filters: set[str | None]) -> DataFrame:
        names = sorted(name for name in filters if name is not None)
        filtered, unfiltered = bool(names), None in filters
        # the kernel itself drops vectors with NULL elements
        usable = chunks.filter((F.size("embedding") == dim) & F.col("document_id").isNotNull())
        wanted = named_collections(names) if filtered else None
        how = "left" if unfiltered else "inner"
        if placed and filtered and not unfiltered:
            listed = [r.collection_id for r in wanted.select("collection_id").distinct().limit(LISTED_NAMES + 1).collect()]
            if len(listed) <= LISTED_NAMES:
                usable = usable.filter(in_collections(chunks, listed))
        if few_documents():
            found = known.join(wanted, "collection_id", how) if filtered else known
            return usable.drop("collection_id").join(F.broadcast(found), "document_id")
        if not filtered:
            if missing_documents() is not None:
                return usable.join(F.broadcast(missing_documents()), "document_id", "left_anti")
            return join_chunks_documents(usable.drop("collection_id"), known)
        return usable.drop("collection_id").join(known.join(wanted, "collection_id", how), "document_id")

    return build


def topk_search_batch(
    queries: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    collections: DataFrame,
    dim: int = VECTOR_DIM,
    placed: bool = False,
    **budget,
) -> DataFrame:
    """Nearest chunks of every query within its own ``top_n`` and optional collection.

    ``query_id, chunk_id, document_id, distance, cos, rk``. Same-named
    collections of several owners are all searched. A query without hits gives
    no rows.
    """
    return knn(queries, candidates(chunks, documents, collections, dim, placed), dim, **budget)


def search(
    vector: list[float],
    chunks: DataFrame,
    documents: DataFrame,
    collections: DataFrame,
    top_n: int | None = DEFAULT_TOP_N,
    filtre: str | None = None,
    dim: int = VECTOR_DIM,
    placed: bool = False,
) -> DataFrame:
    """One request: the nearest chunks, best first; ``placed`` as for ``candidates``."""
    request = chunks.sparkSession.createDataFrame(
        [(0, [float(x) for x in vector], top_n, filtre)],
        "query_id long, embedding array<double>, top_n int, filtre string",
    )
    hits = topk_search_batch(request, chunks, documents, collections, dim, placed)
    ordered = hits.drop("query_id").orderBy(F.asc_nulls_last("distance"), "chunk_id")
    return ordered if top_n is None else ordered.limit(max(top_n, 0))


def pairwise_cosine(questions: DataFrame, responses: DataFrame, key: str, response_key: str) -> DataFrame:
    """Similarity of each response to the one question of its ``key``, as column ``cos``."""
    asked = questions.select(key, F.col("embedding").alias("_question"))
    return (
        spread_join(responses, asked, [key], response_key, "inner")
        .withColumn("cos", cosine_similarity(F.col("_question"), F.col("embedding")))
        .drop("_question", "embedding")
    )


def search_result_shape(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits as returned to the caller, with chunk text and chosen collection.

    Texts are fetched for the surviving hits only.
    """
    chosen = queries.select(
        F.col("query_id").cast("long"),
        F.coalesce(optional_filter(F.col("filtre")), F.lit(NO_COLLECTION)).alias("collection_selectionnee"),
    )
    bound = queries.agg(F.sum("top_n").alias("rows"), F.count_if(F.col("top_n").isNull()).alias("unlimited")).first()
    if not bound["unlimited"] and (bound["rows"] or 0) <= BROADCAST_ROWS:
        hits = F.broadcast(hits)  # at most the sum of all top_n, so the texts stay where they are
    return (
        chunks.select(F.col("chunk_id").cast("long"), "chunk_text")
        .join(hits, "chunk_id")
        .join(chosen, "query_id")
        .select("query_id", "rk", "chunk_id", "document_id", "chunk_text", "distance", "collection_selectionnee")
    )


def search_response_nested(shaped: DataFrame) -> DataFrame:
    """All hits of a query in one record; at most ``top_n`` elements each."""
    hit = F.struct("rk", "chunk_id", "document_id", "chunk_text", "distance", "collection_selectionnee")
    return shaped.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("results"))


def mean_cos_similarity(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.avg("cos").alias("mean_cos_similarity"))


def cos_similarity_top_i(hits: DataFrame, n: int) -> DataFrame:
    """One column per rank, ``cos_similarity_top_1`` to ``cos_similarity_top_n``; fails on a higher rank."""
    ranks = list(range(1, n + 1))
    too_high = F.raise_error(F.concat(F.lit(f"rank above {n}: "), F.col("rk").cast("string")))
    wide = hits.withColumn("rk", F.when(F.col("rk") <= n, F.col("rk")).otherwise(too_high.cast("int"))).groupBy("query_id").pivot("rk", ranks).agg(F.first("cos"))
    return wide.select("query_id", *[F.col(str(i)).alias(f"cos_similarity_top_{i}") for i in ranks])


def search_metrics_long(hits: DataFrame, queries: DataFrame, params: dict[str, str]) -> DataFrame:
    """Parameters and metrics of every search as ``(query_id, kind, key, value)``.

    ``collection_choisie`` says whether a collection was chosen; its name is in
    ``collection_name``. Searches without hits have parameters only.
    """
    def rows(kind: str, pairs: list[tuple]):
        return F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.cast("string").alias("value"))
                for key, value in pairs
            ]
        )

    chosen = optional_filter(F.col("filtre"))
    logged = [(F.lit(key), F.lit(value)) for key, value in params.items()] + [
        (F.lit("collection_choisie"), F.when(chosen.isNull(), "False").otherwise("True")),
        (F.lit("collection_name"), chosen),
    ]
    param_rows = queries.select(
        F.col("query_id").cast("long"), F.explode(rows("param", logged)).alias("row")
    ).filter(F.col("row.value").isNotNull())
    # the mean shares the hits' partitioning by query, so the search runs once
    with_mean = hits.withColumn("_mean", F.avg("cos").over(Window.partitionBy("query_id")))
    top = rows("metric", [(F.concat(F.lit("cos_similarity_top_"), F.col("rk").cast("string")), F.col("cos"))])
    mean = rows("metric", [(F.lit("mean_cos_similarity"), F.col("_mean"))])
    metric_rows = with_mean.select(
        "query_id", F.explode(F.when(F.col("rk") == 1, F.concat(top, mean)).otherwise(top)).alias("row")
    )
    return param_rows.unionByName(metric_rows).select("query_id", "row.*")
