"""Reading the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagelake.schema import TABLES


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table with its declared schema; nothing is inferred."""
    return spark.read.schema(TABLES[table]).parquet(f"{root}/{table}").select(TABLES[table].names)


def scan_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet file or folder, as stored, optionally pruned to ``columns``."""
    df = spark.read.parquet(path)
    return df.select(columns) if columns else df


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int,
    **options: str,
) -> DataFrame:
    """A table of a relational database, read in parallel ranges of ``partition_column``."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
            numPartitions=partitions, **options,
        )
        .load()
    )
