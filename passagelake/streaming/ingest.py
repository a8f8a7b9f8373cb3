"""Continuous ingest of arriving files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from passagelake.functions.encoders import EncoderFactory, HashingEncoder
from passagelake.operators.search import BROADCAST_ROWS
from passagelake.plans.ingest import ingest
from passagelake.schema import TABLES
from passagelake.session import FILE_ROWS, materialise
from passagelake.sources.files import FILE_SCHEMA
from passagelake.sources.sinks import sink_documents_chunks


# Files of a batch that a task reads at most, where there are more than that for each core.
TASK_FILES = 256
# Batch folders that a batch reads besides the keys gathered so far; Spark lists more than 32 paths in a job of its own.
RECENT_FOLDERS = 16
KEYS = ["collection_id", "title_document"]
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listed_by_cores(spark: SparkSession) -> Iterator[None]:
    """While this lasts, the files of a stream's batch are listed by as many tasks as there are cores, not by one for each file."""
    tasks = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, min(int(tasks), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, tasks)


class StoredKeys:
    """Keys of the stored documents, for the batches of one start of a stream.

    Each batch writes a folder of its own, so reading them all takes longer with every batch. The keys of earlier
    folders are gathered in one copy below the shared folder, renewed when ``RECENT_FOLDERS`` have come since; a batch
    reads the copy and the folders after it. A folder that has gone or has another time of change, as after a delete
    in stored tables, makes the copy anew.
    """

    def __init__(self, root: str):
        self.path = f"{root}/documents"
        self.gathered: dict[str, int] = {}
        self.copy: DataFrame | None = None

    def before(self, spark: SparkSession, run_id: str, batch_id: int) -> DataFrame:
        """Keys of all other runs and of this run's earlier batches; what a batch wrote in a failed try is not stored yet."""
        found = {
            folder: changed for folder, changed in self._folders(spark)
            if not folder.startswith(f"run_id={run_id}/") or int(folder.rpartition("=")[2]) < batch_id
        }
        if any(found.get(folder) != changed for folder, changed in self.gathered.items()):
            self.gathered, self.copy = {}, None
        recent = sorted(found.keys() - self.gathered.keys())
        keys = self._read(spark, recent)
        if self.copy is not None:
            keys = self.copy.unionByName(keys)
        if len(recent) > RECENT_FOLDERS:
            keys = self.copy = materialise(keys.distinct(), "stored-keys")
            self.gathered = found
        return keys

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        schema = TABLES["documents"]
        if not folders:
            return spark.createDataFrame([], schema).select(KEYS)
        return spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for folder in folders]).select(KEYS)

    def _folders(self, spark: SparkSession) -> list[tuple[str, int]]:
        """``run_id=../batch_id=..`` of all batches with their times of change."""
        top = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []  # the first batch of the first run
        runs = [run.getPath() for run in fs.listStatus(top) if run.getPath().getName().startswith("run_id=")]
        return [(f"{run.getName()}/{batch}", changed) for run in runs for batch, changed in self._batches(spark, fs.listStatus(run))]

    def _batches(self, spark: SparkSession, listed) -> list[tuple[str, int]]:
        """Folders of batches in a listing: from its text, a single call to the JVM, or one by one if that tells other things."""
        told = re.findall(r"path=[^;]*/(batch_id=[0-9]+);[^{}]*?modification_time=([0-9]+)", spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(listed))
        if len(told) == len(listed):
            return [(name, int(changed)) for name, changed in told]
        each = [(batch.getPath().getName(), batch.getModificationTime()) for batch in listed]
        return [(name, changed) for name, changed in each if name.startswith("batch_id=")]


def stream_ingest(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint: str,
    to_uploads: Callable[[DataFrame], DataFrame],
    now: Column,
    posted_by: Column,
    encoder: EncoderFactory = HashingEncoder(),
    files_per_batch: int | None = None,
    pdf_decoder: Callable[[bytes], str] | None = None,
) -> StreamingQuery:
    """Start ingesting files that are or arrive in ``folder``, until none is left.

    ``to_uploads`` turns ``path, modificationTime, length, content`` into the
    upload columns of ``plans.ingest.ingest``. Each batch writes folders named
    by the stream's id, which its checkpoint keeps, and the batch's id: a repeated
    batch replaces its own output, and a new checkpoint or a bulk ingest on the
    same root adds to what is there. The file source does not report empty
    files, so unlike a bulk ingest the stream stores no documents without text.
    """
    reader = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    stored = StoredKeys(root)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if files_per_batch:
            # Spark counts a file as 4 MB when it deals files to tasks; each task would write small files of its own
            batch = batch.coalesce(max(session.sparkContext.defaultParallelism, -(-files_per_batch // TASK_FILES)))
        run_id = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        result = ingest(
            to_uploads(batch), stored.before(session, run_id, batch_id), now, posted_by, encoder,
            pdf_decoder=pdf_decoder, small_batch=files_per_batch is not None and files_per_batch <= BROADCAST_ROWS,
        )
        documents, rejects = result.documents, result.quarantine
        if files_per_batch:  # a row for each file at most
            parts = -(-files_per_batch // FILE_ROWS)
            documents, rejects = documents.coalesce(parts), rejects.coalesce(parts)

        def write_rejects() -> None:
            rejects.write.mode("overwrite").parquet(f"{root}/quarantine/run_id={run_id}/batch_id={batch_id}")

        with ThreadPoolExecutor(1) as beside:  # a few rows, which do not keep the chunks waiting
            written = beside.submit(inheritable_thread_target(session)(write_rejects))
            sink_documents_chunks(documents, result.chunks, root, run_id, batch_id)
            written.result()

    return (
        reader.load(folder)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
