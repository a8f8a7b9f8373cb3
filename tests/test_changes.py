"""Deletes on stored tables touch only the folders that hold the rows."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from passagelake.session import scratch_path
from passagelake.sources import changes, sinks


@pytest.fixture
def root(spark):
    root = scratch_path(spark, "tables")
    for batch in range(2):
        rows = spark.range(batch * 200, batch * 200 + 200)
        documents = rows.select(F.col("id").alias("document_id"), (F.col("id") % 10).cast("int").alias("collection_id"))
        chunks = documents.select("*", F.explode(F.sequence(F.lit(0), (F.col("document_id") % 3).cast("int"))).alias("chunk_index"))
        sinks.sink_documents_chunks(documents, chunks, root, "bulk", batch)
    return root


def files_of(root, table):
    base = f"{root}/{table}".removeprefix("file:")
    return {os.path.relpath(f, base) for f in glob.glob(f"{base}/**/*.parquet", recursive=True)}


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "document_id long")


def keys(spark, root, table):
    return sorted(r.document_id for r in spark.read.parquet(f"{root}/{table}").select("document_id").collect())


@pytest.mark.parametrize("limit", [500_000, 0])
def test_only_touched_folders_change(spark, root, monkeypatch, limit):
    monkeypatch.setattr(changes, "BROADCAST_ROWS", limit)
    before = {t: (files_of(root, t), keys(spark, root, t)) for t in ("documents", "chunks")}
    gone = [3, 13, 23, 203, 9_999]
    touched = changes.delete_documents(spark, root, ids(spark, gone + gone))
    assert touched["documents"] == ["run_id=bulk/batch_id=0", "run_id=bulk/batch_id=1"]
    assert touched["chunks"] == [f"run_id=bulk/batch_id={b}/collection_bucket=3" for b in (0, 1)]
    for table, (files, kept) in before.items():
        assert keys(spark, root, table) == [k for k in kept if k not in gone]
        now = files_of(root, table)
        same = {f for f in files if os.path.dirname(f) not in touched[table]}
        assert same <= now and not (files - same) & now


def test_an_emptied_folder_goes(spark, root):
    changes.delete_documents(spark, root, ids(spark, range(200)))
    assert keys(spark, root, "documents") == list(range(200, 400))
    assert not [f for f in files_of(root, "chunks") if "batch_id=0" in f]


def test_nothing_to_delete(spark, root):
    before = files_of(root, "chunks") | files_of(root, "documents")
    assert changes.delete_documents(spark, root, ids(spark, [9_999])) == {"documents": [], "chunks": []}
    assert changes.delete_documents(spark, root, ids(spark, [])) == {"documents": [], "chunks": []}
    assert files_of(root, "chunks") | files_of(root, "documents") == before


def test_a_job_that_dies_is_run_again(spark, root, monkeypatch):
    real = changes._delete

    def dies(spark, root, table, doomed):
        if table == "chunks":
            raise RuntimeError("killed")
        return real(spark, root, table, doomed)

    monkeypatch.setattr(changes, "_delete", dies)
    with pytest.raises(RuntimeError, match="killed"):
        changes.delete_documents(spark, root, ids(spark, [5]))
    monkeypatch.setattr(changes, "_delete", real)
    changes.delete_documents(spark, root, ids(spark, [5]))
    assert 5 not in keys(spark, root, "chunks") + keys(spark, root, "documents")
