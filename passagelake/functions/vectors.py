"""Vector expressions. They define the results; `operators.knn` is the fast path."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision; NULL for a NULL or shorter side."""
    return F.sqrt(
        _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when either one is all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    product = dot(a, b)
    return F.when(product.isNotNull(), F.coalesce(F.try_divide(product, norms), F.lit(0.0)))


def dim_ok(vector: Column, dim: int) -> Column:
    """True for a vector of exactly ``dim`` non-null numbers."""
    return F.coalesce(
        (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False)
    )


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean of all vectors of a key, as ``(key, vector)``.

    ``Summarizer`` adds vectors up on the map side, so one partial sum per task
    and key is shuffled, however many rows the key has.
    """
    return (
        df.filter(F.col(vector).isNotNull())
        .groupBy(key)
        .agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("_mean"))
        .select(key, vector_to_array("_mean").alias(vector))
    )
