"""The object store: contents by bucket and name, listed without reading them, moved when a bucket is renamed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT_SCHEMA = "object_name string, size_bytes long, content binary, bucket string, batch string"
MOVE_SCHEMA = "old_bucket string, new_bucket string, object_name string, size_bytes long"


def put_objects(objects: DataFrame, store: str, batch: str) -> None:
    """Store ``bucket, object_name, content``; a batch that is put again replaces its own objects only.

    Rows are rebalanced by bucket: AQE splits a large bucket into parts of the
    advisory size and joins small ones, so rows decide the parallelism.
    """
    rows = objects.select("bucket", "object_name", F.length("content").cast("long").alias("size_bytes"), "content")
    _write(rows, store, batch)


def _write(rows: DataFrame, store: str, batch: str) -> None:
    (
        rows.withColumn("batch", F.lit(batch)).hint("rebalance", "bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{store}/objects")
    )


def stored_objects(spark: SparkSession, store: str) -> DataFrame:
    """All objects; a filter on ``bucket`` reads its folders only."""
    return spark.read.schema(OBJECT_SCHEMA).parquet(f"{store}/objects")


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """``bucket, object_name, size_bytes`` of all objects; contents are not read."""
    return stored_objects(spark, store).select("bucket", "object_name", "size_bytes")


def recorded_moves(spark: SparkSession, store: str, job: str) -> DataFrame | None:
    """Objects that a job has copied, once all of them are; None before."""
    try:
        return spark.read.schema(MOVE_SCHEMA).parquet(f"{store}/moves/{job}")
    except AnalysisException:
        return None


def move_objects(spark: SparkSession, store: str, renamed: DataFrame, job: str) -> DataFrame:
    """Move the objects of renamed buckets (``bucket, new_bucket``); gives the record of the moves.

    Executors copy the objects, each into the folder of its new bucket. When every copy has been read back with the
    size of its original, a record with one row for each object is written, and only then are the old folders
    deleted. A job that died is run again with its name: without a record it copies anew, over its own copies, as
    the originals are all there; with one it only deletes. Equal keys move nothing. Until the old folders are gone
    the manifest lists both places.
    """
    moves = renamed.where("bucket <> new_bucket").select("bucket", "new_bucket")
    done = recorded_moves(spark, store, job)
    if done is None:
        batch = f"move-{job}"
        originals = stored_objects(spark, store).where(F.col("batch") != batch).join(moves, "bucket")
        copies = originals.select(F.col("new_bucket").alias("bucket"), "object_name", "size_bytes", "content")
        _write(copies, store, batch)
        copied = stored_objects(spark, store).where(F.col("batch") == batch)
        copied = copied.select(F.col("bucket").alias("new_bucket"), "object_name", F.length("content").cast("long").alias("size_bytes"))
        expected = originals.select(F.col("bucket").alias("old_bucket"), "new_bucket", "object_name", "size_bytes")
        missing = expected.join(copied, ["new_bucket", "object_name", "size_bytes"], "left_anti").count()
        if missing:
            raise RuntimeError(f"{missing} objects were not copied; nothing is deleted")
        _record(expected, f"{store}/moves/{job}")
        done = recorded_moves(spark, store, job)
    # one row for each bucket that held objects, one call for each of its batches
    for row in done.select("old_bucket").distinct().toLocalIterator():
        _delete_originals(spark, store, row["old_bucket"], f"move-{job}")
    return done


def _record(moves: DataFrame, path: str) -> None:
    """Written beside its place and renamed, so that a record is whole or not there."""
    moves.write.mode("overwrite").parquet(f"{path}.partial")
    files, fs = _file_system(moves.sparkSession, path)
    fs.delete(files(path), True)
    if not fs.rename(files(f"{path}.partial"), files(path)):
        raise RuntimeError(f"cannot rename {path}.partial")


def _file_system(spark: SparkSession, path: str):
    files = spark._jvm.org.apache.hadoop.fs.Path
    return files, files(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _delete_originals(spark: SparkSession, store: str, bucket: str, copies: str) -> None:
    """Delete a bucket's batches, except one that was copied into it."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(bucket)
    files, fs = _file_system(spark, store)
    folder = files(f"{store}/objects/bucket={escaped}")
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            if status.getPath().getName() != f"batch={copies}":
                fs.delete(status.getPath(), True)
