"""Session set-up and the shared folder that jobs use for intermediate tables."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("passagelake")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Rows of a stored table that are worth a file of their own.
FILE_ROWS = 1 << 14

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="passagelake-code-")  # read by the driver only, which serves it to the executors
    archive = shutil.make_archive(
        os.path.join(folder, "passagelake"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back on a folder of its own: on a cluster a
    machine-local folder would vanish with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="passagelake-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def in_few_parts(df: DataFrame, rows: int) -> DataFrame:
    """A table of about ``rows`` rows in no more partitions than these need, and than keep all cores busy.

    The partitions of a shuffle are joined as they are read; there are never more of them than before.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / FILE_ROWS)))


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading back.

    The copy outlives lost executors and is read with column pruning. With ``rows``, about how many rows there are
    at most, a small table is not stored in a file for each partition of a shuffle. On a local or mounted folder
    an executor starts processes for every file that it writes.
    """
    spark = df.sparkSession
    if rows is not None:
        df = in_few_parts(df, rows)
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def through_driver(df: DataFrame) -> DataFrame:
    """A table whose number of rows the caller has bounded, collected once: what uses it neither computes nor reads it again."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
