"""Stored cells: the hits of a full scan, from a part of the chunks."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.operators.cells import search_cells, store_cells
from passagelake.operators.knn import knn
from passagelake.session import scratch_path, shared_folder

DIM = 8


def stored(spark, vectors):
    rows = [(i, i % 5, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<float>").repartition(4)


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, embedding array<float>, top_n int")


def clustered(n=3000, groups=30, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, DIM)) * 10
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, DIM)) * 0.3


def hits(df):
    return {(r.query_id, r.rk): (r.chunk_id, r.document_id, r.distance, round(r.cos, 9)) for r in df.collect()}


def full_scan(queries, chunks):
    usable = chunks.filter(F.size("embedding") == DIM)
    return hits(knn(queries.withColumn("filtre", F.lit(None).cast("string")), lambda filters: usable, DIM))


def both(spark, vectors, rows, **options):
    path, chunks, queries = scratch_path(spark, "cells"), stored(spark, vectors), asked(spark, rows)
    store_cells(chunks, path, DIM, **options)
    found = search_cells(queries, path, DIM)
    assert hits(found.hits) == full_scan(queries, chunks)
    return {r.query_id: (r.n_cells, r.n_chunks) for r in found.compared.collect()}


def test_clustered_vectors_are_mostly_skipped(spark):
    vectors = clustered()
    rows = [(q, vectors[q * 7].astype(np.float32).tolist(), 1 + q % 9) for q in range(60)]
    compared = both(spark, vectors, rows)
    assert len(compared) == 60
    assert sum(n for _, n in compared.values()) < 0.1 * 60 * len(vectors)


def test_spread_vectors_give_the_same_hits(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(700, DIM)) * rng.uniform(0.1, 50, size=(700, 1))
    rows = [(q, (rng.normal(size=DIM) * 20).tolist(), int(rng.integers(1, 40))) for q in range(40)]
    both(spark, vectors, rows)


def test_limits_of_all_kinds(spark):
    vectors = clustered(400, 8)
    near = vectors[0].tolist()
    compared = both(spark, vectors, [(1, near, None), (2, near, 0), (3, near, -4), (4, near, 399), (5, near, 5000), (6, near, 1)])
    assert compared[1][1] == compared[5][1] == 400
    assert 2 not in compared and 3 not in compared


def test_copies_and_ties(spark):
    """A third of the chunks are one vector; ties go to the lower chunk id wherever the copies lie."""
    vectors = clustered(600, 6)
    vectors[::3] = vectors[0]
    opposite = [(vectors[0] + sign * np.eye(DIM)[0]).tolist() for sign in (-1, 1)]
    both(spark, [*vectors, *opposite], [(1, vectors[0].tolist(), 5), (2, vectors[0].tolist(), 201), (3, vectors[1].tolist(), 3)], n_cells=12)


def test_equal_distances_in_several_cells(spark):
    """Points of a grid at the same distance of a query lie in different cells: none may be skipped at the limit."""
    grid = np.stack(np.meshgrid(*[[-1.0, 1.0]] * DIM), axis=-1).reshape(-1, DIM)
    both(spark, np.concatenate([grid, grid * 2]), [(1, [0.0] * DIM, 10), (2, [0.0] * DIM, 256), (3, grid[0].tolist(), 9)], n_cells=40)


def test_odd_rows(spark):
    vectors = clustered(100, 4).tolist()
    vectors += [None, [1.0] * 5, [None] + [1.0] * 7, [float("nan")] * DIM, [float("inf")] * DIM]
    both(spark, vectors, [(1, vectors[0], 200), (2, [1.0] * 3, 4), (3, vectors[9], 2)])


@pytest.mark.parametrize("vectors", [[], [None], [[1.0] * DIM]])
def test_empty_and_single(spark, vectors):
    both(spark, vectors, [(1, [0.0] * DIM, 3), (2, [0.0] * DIM, None)])


def test_second_scan_reads_only_the_folders_of_open_cells(spark):
    vectors = clustered()
    path = scratch_path(spark, "cells")
    store_cells(stored(spark, vectors), path, DIM, n_cells=30)
    found = search_cells(asked(spark, [(1, vectors[5].tolist(), 5)]), path, DIM)
    read = found.compared.first().n_cells
    assert read < 6 and found.hits.count() == 5


def test_no_queries(spark):
    path = scratch_path(spark, "cells")
    store_cells(stored(spark, clustered(50, 3)), path, DIM)
    assert search_cells(asked(spark, []), path, DIM).hits.count() == 0


@pytest.mark.parametrize("block_bytes", [128 << 20, 40_000])
def test_a_search_writes_no_row_for_each_cell(spark, block_bytes):
    """Without clusters every query reads most cells; what is written stays a few times the vectors and hits."""
    vectors = np.random.default_rng(2).normal(size=(900, DIM)).astype(np.float32)
    chunks, queries = stored(spark, vectors), asked(spark, [(q, v.tolist(), 1 + q % 3) for q, v in enumerate(vectors)])
    path = scratch_path(spark, "cells")
    store_cells(chunks, path, DIM, n_cells=150)
    top = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{top}/**/*.parquet", recursive=True))
    before = size()
    found = search_cells(queries, path, DIM, block_bytes)
    assert hits(found.hits) == full_scan(queries, chunks)
    assert found.compared.agg(F.sum("n_cells")).first()[0] > 900 * 20
    assert size() - before < 900 * (6 * 4 * DIM + 20 * 48) + (1 << 20)


def test_queries_with_one_id_and_other_limits(spark):
    """Rows of one query id are not multiplied by each other's limits."""
    vectors = clustered(300, 5)
    both(spark, vectors, [(1, vectors[3].tolist(), 4), (1, vectors[3].tolist(), 4), (2, vectors[9].tolist(), 2)])
