"""Upload counters and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default histogram bounds.
DEFAULT_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def upload_counters(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count("*").alias("documents_uploaded_total"),
        F.coalesce(F.sum("num_of_chunks"), F.lit(0)).alias("chunks_created_total"),
    )


def _bounds(value: Column, bounds: list[float]) -> list[tuple[str, Column]]:
    finite = [(repr(float(b)), value <= F.lit(float(b))) for b in bounds]
    return finite + [("+Inf", value.isNotNull())]


def histogram(df: DataFrame, value: str, bounds: list[float] = DEFAULT_BOUNDS, where: Column | None = None) -> DataFrame:
    """Cumulative bucket counts with sum and count: ``le, bucket_count, total_sum, total_count``.

    One pass and one partial row per task, whatever the number of bounds.
    """
    x = F.col(value).cast("double")
    if where is not None:
        x = F.when(where, x)
    observed = df.select(x.alias("x"))
    totals = observed.agg(
        F.array(
            *[
                F.struct(F.lit(le).alias("le"), F.count_if(below).alias("bucket_count"))
                for le, below in _bounds(F.col("x"), bounds)
            ]
        ).alias("buckets"),
        F.sum("x").alias("total_sum"),
        F.count("x").alias("total_count"),
    )
    return totals.select(F.inline("buckets"), "total_sum", "total_count")


def upload_size_histogram(judged: DataFrame, bounds: list[float] = DEFAULT_BOUNDS) -> DataFrame:
    """File sizes of uploads past the duplicate and extension gates; too large ones count."""
    return histogram(judged, "size_bytes", bounds, F.col("outcome").isin("accepted", "too_large"))


def upload_time_histogram(
    log: DataFrame, seconds: str, succeeded: Column, bounds: list[float] = DEFAULT_BOUNDS
) -> DataFrame:
    """Processing times of uploads that ``succeeded``; a refused or failed one is not observed."""
    return histogram(log, seconds, bounds, succeeded)
