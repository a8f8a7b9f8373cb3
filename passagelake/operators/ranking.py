"""Ranks inside groups that may be larger than a task should hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelake.session import materialise


def place_in_groups(rows: DataFrame, group: list[str], order: list[Column], label: str) -> DataFrame:
    """Adds ``_rank``, a long counted from 1 inside each group in a total order; no group at all is one group.

    Rows are dealt to ranges of (group, order) and stored, so a large group lies in many partitions. A row's rank is
    its place among its group's rows of the partition, after the rows of the partitions before; of those only
    counts are read, one for each group and partition.
    """
    dealt = rows.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("_part", F.spark_partition_id())
    stored = materialise(dealt, label)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    starts = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    placed = stored.withColumn("_place", F.row_number().over(within)).join(starts, [*group, "_part"])
    return placed.withColumn("_rank", F.col("_place") + F.col("_start")).drop("_part", "_place", "_start")


def rank_in_groups(rows: DataFrame, group: list[str], order: list[Column], label: str) -> DataFrame:
    """``place_in_groups`` with the rank as int column ``rk``."""
    placed = place_in_groups(rows, group, order, label)
    return placed.withColumn("rk", F.col("_rank").cast("int")).drop("_rank")
