"""Deletes on stored tables that rewrite only the folders they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.schema import COLLECTION_BUCKET
from passagelake.session import materialise

# Partition columns of the tables that ``sinks.sink_documents_chunks`` writes.
FOLDERS = {"documents": ["run_id", "batch_id"], "chunks": ["run_id", "batch_id", COLLECTION_BUCKET]}
# Ids that may be broadcast, after counting them.
BROADCAST_ROWS = 500_000


def _folder(columns: list[str]) -> Column:
    """A folder's name: a filter on it reaches the listing of files."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])


def delete_documents(spark: SparkSession, root: str, ids: DataFrame) -> dict[str, list[str]]:
    """Delete documents and their chunks below ``root``; gives the folders that were rewritten or emptied.

    Documents go first: chunks without document are found by no search. A job that died is run again with the same
    ids; what is gone already touches nothing.
    """
    doomed = materialise(ids.select(F.col("document_id").cast("long")).distinct(), "doomed")
    few = doomed.count() <= BROADCAST_ROWS
    return {table: _delete(spark, root, table, F.broadcast(doomed) if few else doomed) for table in ("documents", "chunks")}


def _delete(spark: SparkSession, root: str, table: str, doomed: DataFrame) -> list[str]:
    path, columns = f"{root}/{table}", FOLDERS[table]
    stored = spark.read.parquet(path)
    hit = stored.select("document_id", *columns).join(doomed, "document_id", "left_semi")
    touched = sorted(r.folder for r in hit.select(_folder(columns).alias("folder")).distinct().collect())  # one for each folder
    if not touched:
        return []
    rest = stored.where(_folder(columns).isin(touched)).join(doomed, "document_id", "left_anti")
    kept = materialise(rest, f"kept-{table}")  # the folders that are read are about to be replaced
    left = {r.folder for r in kept.select(_folder(columns).alias("folder")).distinct().collect()}
    (
        kept.hint("rebalance", *columns).sortWithinPartitions(*columns, "collection_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
    )
    files = spark._jvm.org.apache.hadoop.fs.Path
    fs = files(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in touched:
        if folder not in left:  # nothing is written for a folder without rows, so it would stay
            fs.delete(files(f"{path}/{folder}"), True)
    return touched
