"""Exact search that skips vectors: chunks stored by cell, and cells that cannot hold a hit are not read.

``store_cells`` assigns every chunk to its nearest centre and keeps, for each cell, the centre, the smallest and the
largest distance of a member to it, and the number of members. By the triangle inequality a member of a cell is at
least ``max(d - outer, inner - d, 0)`` away from a query at distance ``d`` of the centre.

``search_cells`` reads the nearest cells first, until they hold as many chunks as a query wants. The distance of the
last of these hits is a limit: in a second scan only cells whose least distance does not exceed it are read, and
these hold all hits that are still missing. Hits are those of ``knn`` over all chunks, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.functions.vectors import dim_ok
from passagelake.operators.knn import (
    BLOCK_BYTES, CELL_COLUMNS, PARTIAL_SCHEMA, REFINE_BYTES, partial_results, rank_hits, valid_queries, vectors_of,
)
from passagelake.session import materialise

# Cells of an index at most: with vectors of 1,024 numbers their centres take 32 MB. The centres are fitted on about
# this many chunks for each cell; every chunk is assigned and measured.
MAX_CELLS = 4_096
SAMPLE_PER_CELL = 32
FIT_ROUNDS = 5

CELL_SCHEMA = "cell int, centre array<double>, inner double, outer double, n long"


@dataclass
class CellSearch:
    """Hits as ``knn`` gives them, and per query the cells and chunks that it was compared with."""

    hits: DataFrame
    compared: DataFrame


def store_cells(chunks: DataFrame, path: str, dim: int, n_cells: int | None = None) -> None:
    """Store ``chunk_id, document_id, embedding`` by cell below ``path``; by default about the root of their number.

    Chunks that cannot be compared (no vector, another length, NULL or non-finite numbers) are left out. The centres
    are fitted on a sample chosen by a hash of the chunk id; that choice decides how much a search reads, never what
    it finds. A cell with very many members, such as copies of one vector, lies in several files.
    """
    spark = chunks.sparkSession
    odd = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    usable = chunks.filter(dim_ok(F.col("embedding"), dim) & ~odd & F.col("document_id").isNotNull()).select(
        F.col("chunk_id").cast("long"), F.col("document_id").cast("long"), "embedding"
    )
    n = usable.count()
    k = min(MAX_CELLS, n_cells or max(1, int(n**0.5)))
    shared = spark.sparkContext.broadcast(_centres(usable, n, k, dim))
    schema = T.StructType([*usable.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])
    placed = usable.mapInArrow(_nearest(shared, dim), schema)
    (
        placed.hint("rebalance", "cell").sortWithinPartitions("cell", "radius")
        .write.mode("overwrite").partitionBy("cell").parquet(f"{path}/chunks")
    )
    stored = spark.read.schema(schema).parquet(f"{path}/chunks") if n else placed.limit(0)
    sizes = stored.groupBy("cell").agg(F.min("radius").alias("inner"), F.max("radius").alias("outer"), F.count("*").alias("n"))
    centres = spark.createDataFrame(list(enumerate(shared.value.tolist())), "cell int, centre array<double>")
    centres.join(sizes, "cell").select("cell", "centre", "inner", "outer", "n").write.mode("overwrite").parquet(f"{path}/cells")
    shared.destroy()


def _centres(usable: DataFrame, n: int, k: int, dim: int) -> np.ndarray:
    """At most ``k`` centres of a sample of about ``k * SAMPLE_PER_CELL`` chunks."""
    if n == 0:
        return np.zeros((1, dim))
    wanted = k * SAMPLE_PER_CELL
    sample = usable if n <= wanted else usable.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(n)) < wanted)
    rows = materialise(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), "cell-sample")
    if k == 1 or rows.isEmpty():
        return np.zeros((1, dim))
    return np.array(KMeans(k=k, initMode="random", seed=1, maxIter=FIT_ROUNDS).fit(rows).clusterCenters())


def _nearest(shared, dim: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        norms = (centres**2).sum(axis=1)
        step = max(1, REFINE_BYTES // (8 * max(len(centres), dim)))
        for batch in batches:
            x = vectors_of(batch.column("embedding"), dim)[0].astype(np.float64)
            cell, radius = np.empty(len(x), np.int32), np.empty(len(x))
            for start in range(0, len(x), step):
                part = slice(start, start + step)
                cell[part] = (norms[None, :] - 2.0 * (x[part] @ centres.T)).argmin(axis=1)
                radius[part] = np.sqrt(((x[part] - centres[cell[part]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(radius)], names=[*batch.schema.names, "cell", "radius"]
            )

    return work


@dataclass
class _Cells:
    """The cells of an index as arrays; ``MAX_CELLS`` rows at most."""

    cell: np.ndarray
    centre: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    n: np.ndarray

    def least(self, vector: np.ndarray) -> np.ndarray:
        """Least distance that a member of each cell can have, less what rounding can amount to.

        A computed distance is off by a share of at most ``(dim + 4) * eps``; four times that share of both
        distances is taken off.
        """
        d = np.sqrt(((self.centre - vector) ** 2).sum(axis=1))
        slack = 4 * (len(vector) + 4) * np.finfo(np.float64).eps * (d + self.outer)
        return np.maximum(np.maximum(d - self.outer, self.inner - d) - slack, 0.0)

    def nearest(self, least: np.ndarray, top_n: int | None) -> np.ndarray:
        """Which cells are read first: the nearest ones, until they hold ``top_n`` chunks."""
        first = np.zeros(len(least), bool)
        if top_n is None:
            first[:] = True
        elif top_n > 0:
            order = np.lexsort((self.cell, least))
            held = np.cumsum(self.n[order])
            first[order[: int(np.searchsorted(held, top_n)) + 1]] = True
        return first


def _load(spark: SparkSession, path: str, dim: int) -> _Cells:
    table = spark.read.schema(CELL_SCHEMA).parquet(f"{path}/cells").orderBy("cell").toArrow().combine_chunks()
    if table.num_rows == 0:
        return _Cells(np.zeros(0, np.int32), np.zeros((0, dim)), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
    column = lambda name: table[name].to_numpy()
    centre = table["centre"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    return _Cells(column("cell"), centre, column("inner"), column("outer"), column("n"))


def _visits(shared, dim: int, second: bool):
    """A row for each query with cells to read, as bits: in the first scan the nearest, in the second those within the limit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: _Cells = shared.value
        width = int(cells.cell.max(initial=-1)) + 1
        for batch in batches:
            vectors = vectors_of(batch.column("embedding"), dim)[0].astype(np.float64)
            wanted = np.zeros((len(vectors), len(cells.cell)), bool)
            if second:
                read = np.frombuffer(b"".join(batch.column("_cells").to_pylist()), np.uint8).reshape(len(vectors), -1)
                read = np.unpackbits(read, axis=1)[:, cells.cell].astype(bool)
                limit = batch.column("_limit").to_numpy()
                for i, vector in enumerate(vectors):
                    wanted[i] = ~read[i] & (cells.least(vector) <= limit[i])
            else:
                for i, top_n in enumerate(batch.column("top_n").to_pylist()):
                    wanted[i] = cells.nearest(cells.least(vectors[i]), top_n)
            found = np.flatnonzero(wanted.any(axis=1))
            if not len(found):
                continue
            wanted, kept = wanted[found], batch.take(pa.array(found))
            bits = np.zeros((len(found), width), bool)
            bits[:, cells.cell] = wanted
            packed = pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())
            limit = kept.column("_limit") if second else pa.array(np.full(len(found), np.inf))
            yield pa.RecordBatch.from_arrays(
                [
                    *[kept.column(name) for name in ("query_id", "embedding", "top_n", "filtre")], packed, limit,
                    pa.array(wanted.sum(axis=1)), pa.array(wanted @ cells.n),
                ],
                names=["query_id", "embedding", "top_n", "filtre", *CELL_COLUMNS, "n_cells", "n_chunks"],
            )

    return work


def search_cells(queries: DataFrame, path: str, dim: int, block_bytes: int = BLOCK_BYTES) -> CellSearch:
    """Nearest chunks of every query over an index of ``store_cells``: the same hits as ``knn`` over its chunks.

    ``queries`` are ``query_id, embedding, top_n``; a ``top_n`` of NULL reads all cells. Filters on a collection are
    not taken: those searches read the stored layout, see ``search.candidates``. Queries without a usable vector and
    an empty index give no rows.
    """
    spark = queries.sparkSession
    asked = valid_queries(queries.withColumn("filtre", F.lit(None).cast("string")), dim)
    shared = spark.sparkContext.broadcast(_load(spark, path, dim))
    kept = ["query_id", "embedding", "top_n", "filtre"]
    added = "_cells binary, _limit double, n_cells long, n_chunks long"
    visit_schema = T.StructType([*asked.select(kept).schema.fields, *T.StructType.fromDDL(added).fields])

    def members(numbers: set[int]) -> DataFrame:
        """Chunks of the cells to read; the filter reaches their folders."""
        if not numbers:
            return spark.createDataFrame([], "chunk_id long, document_id long, embedding array<float>, radius double, cell int")
        return spark.read.parquet(f"{path}/chunks").filter(F.col("cell").isin(sorted(numbers)))

    def scan(rows: DataFrame, second: bool) -> tuple[DataFrame, DataFrame, set[int]]:
        # a row for each query, however many cells it reads
        visits = materialise(rows.mapInArrow(_visits(shared, dim, second), visit_schema), "cell-visits")
        parts, limits = partial_results(visits.drop("n_cells", "n_chunks"), members, dim, block_bytes, in_cells=True)
        return visits, parts, limits

    first, parts, limits = scan(asked, second=False)
    ranked = materialise(rank_hits(parts, limits), "cell-hits")
    last = ranked.filter(F.col("rk") == F.col("top_n")).select("query_id", F.col("rk").alias("top_n"), F.col("distance").alias("_limit"))
    open_queries = first.filter(F.col("top_n") > 0).select(*kept, "_cells").join(last, ["query_id", "top_n"]).select(*kept, *CELL_COLUMNS)
    second, more, _ = scan(open_queries, second=True)
    hits = rank_hits(ranked.select(*[field.split()[0] for field in PARTIAL_SCHEMA.split(", ")]).unionByName(more), limits)
    compared = first.unionByName(second).groupBy("query_id").agg(F.sum("n_cells").alias("n_cells"), F.sum("n_chunks").alias("n_chunks"))
    return CellSearch(hits.drop("top_n"), compared)
