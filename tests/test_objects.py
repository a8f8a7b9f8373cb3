"""The object store: puts, manifest, and moves that are cut off."""

import pytest
from pyspark.sql import functions as F

from passagelake.session import scratch_path
from passagelake.sources import objects


def contents(spark, store):
    rows = objects.stored_objects(spark, store).collect()
    assert all(r.size_bytes == len(r.content) for r in rows)
    return sorted((r.bucket, r.object_name, bytes(r.content)) for r in rows)


@pytest.fixture
def store(spark):
    store = scratch_path(spark, "store")
    rows = [("collection-1-a", f"Doc {i}.txt", f"text {i}".encode()) for i in range(30)]
    rows += [("collection-2-é b", "x=y.html", b""), ("collection-3-c", "same", b"\x00\xff")]
    objects.put_objects(spark.createDataFrame(rows, "bucket string, object_name string, content binary"), store, "bulk")
    return store


def renames(spark, rows):
    return spark.createDataFrame(rows, "bucket string, new_bucket string")


MOVES = [("collection-1-a", "collection-1-new"), ("collection-2-é b", "collection-2-ü"), ("collection-3-c", "collection-3-c"), ("missing", "elsewhere")]


def moved(before):
    names = dict(MOVES)
    return sorted((names.get(b, b), n, c) for b, n, c in before)


def test_a_batch_put_again_replaces_itself_only(spark, store):
    before = contents(spark, store)
    more = spark.createDataFrame([("collection-1-a", "late", b"1")], "bucket string, object_name string, content binary")
    objects.put_objects(more, store, "second")
    objects.put_objects(more.withColumn("content", F.lit(b"22")), store, "second")
    assert contents(spark, store) == sorted(before + [("collection-1-a", "late", b"22")])


def test_manifest_reads_no_content(spark, store):
    plan = objects.manifest(spark, store)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert objects.manifest(spark, store).count() == 32


def test_objects_move_and_equal_keys_stay(spark, store):
    before = contents(spark, store)
    record = objects.move_objects(spark, store, renames(spark, MOVES), "job")
    assert contents(spark, store) == moved(before)
    assert record.count() == 31 and record.where("old_bucket = new_bucket").isEmpty()
    objects.move_objects(spark, store, renames(spark, MOVES), "job")
    assert contents(spark, store) == moved(before)


@pytest.mark.parametrize("step", ["_write", "_record", "_delete_originals"])
def test_a_job_that_dies_is_run_again(spark, store, monkeypatch, step):
    """Cut off while copying, before the record, and after the first of two deletions."""
    before, real, calls = contents(spark, store), getattr(objects, step), []

    def dies(*args):
        calls.append(args)
        if step == "_delete_originals" and len(calls) == 1:
            return real(*args)
        if step == "_write":  # half of the copies are there
            real(args[0].where("object_name < 'Doc 2'"), *args[1:])
        raise RuntimeError("killed")

    monkeypatch.setattr(objects, step, dies)
    with pytest.raises(RuntimeError, match="killed"):
        objects.move_objects(spark, store, renames(spark, MOVES), "job")
    monkeypatch.setattr(objects, step, real)
    objects.move_objects(spark, store, renames(spark, MOVES), "job")
    assert contents(spark, store) == moved(before)


def test_nothing_is_deleted_while_copies_are_missing(spark, store, monkeypatch):
    before, real = contents(spark, store), objects._write
    monkeypatch.setattr(objects, "_write", lambda rows, *a: real(rows.where("object_name <> 'Doc 3.txt'"), *a))
    with pytest.raises(RuntimeError, match="1 objects"):
        objects.move_objects(spark, store, renames(spark, MOVES), "job")
    assert set(before) <= set(contents(spark, store))


def test_buckets_that_trade_names(spark, store):
    before = contents(spark, store)
    trade = {"collection-1-a": "collection-3-c", "collection-3-c": "collection-1-a"}
    objects.move_objects(spark, store, renames(spark, list(trade.items())), "trade")
    assert contents(spark, store) == sorted((trade.get(b, b), n, c) for b, n, c in before)


def test_no_renames(spark, store):
    before = contents(spark, store)
    assert objects.move_objects(spark, store, renames(spark, []), "none").count() == 0
    assert contents(spark, store) == before
