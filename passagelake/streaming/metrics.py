"""Upload metrics per time window over a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from passagelake.operators.metrics import DEFAULT_BOUNDS


def upload_metrics(
    requests: DataFrame, ts: str = "ts", seconds: str = "value", window: str = "1 day", bounds: list[float] = DEFAULT_BOUNDS
) -> DataFrame:
    """Count, sum and cumulative bucket counts of processing times per window.

    The same plan serves a batch and a stream; the state is one row per window.
    """
    buckets = [
        F.count_if(F.col(seconds) <= F.lit(b)).alias("le_" + repr(float(b)).replace(".", "_")) for b in bounds
    ]
    return (
        requests.groupBy(F.window(ts, window).alias("w"))
        .agg(F.count("*").alias("n_uploads"), F.sum(seconds).alias("total_seconds"), *buckets)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_uploads", "total_seconds",
                *["le_" + repr(float(b)).replace(".", "_") for b in bounds])
    )


def replay(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """A stored table as a stream, whether ``path`` is one file or a folder of part files.

    The file source takes a folder or a pattern; a pattern for just this name stands for both kinds.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def stream_upload_metrics(
    requests: DataFrame, path: str, checkpoint: str, ts: str = "ts", late_by: str = "1 hour", **options
) -> StreamingQuery:
    """Append closed windows to ``path``; rows later than ``late_by`` are dropped."""
    timed = requests.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need an instant
    return (
        upload_metrics(timed.withWatermark(ts, late_by), ts, **options)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
