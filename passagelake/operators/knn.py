"""Exact nearest chunks for many queries at once.

A block of queries of bounded size is broadcast; every task walks its chunks as
Arrow batches, keeps the best ``top_n`` per query and emits only those. What is
shuffled for the final ranking is therefore at most ``top_n`` rows per query
and task, never a vector and never the full set of pairs.

Queries beyond the broadcast budget make several blocks, which one scan of the
chunks runs together: a task takes its chunks in pieces of bounded size, prepares
a piece once, goes through all blocks for it, emits the piece's hits and keeps only the
distance that a later hit has to beat. Hits of a query without limit, or with a
very large one, are ranked by ranges and not in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagelake.functions.text import optional_filter
from passagelake.functions.vectors import dim_ok
from passagelake.operators.ranking import rank_in_groups
from passagelake.session import materialise, scratch_path

# Bytes of vectors and running results that one broadcast block may hold.
BLOCK_BYTES = 128 << 20
# Blocks of one scan; small ones are more, up to so many bytes together. A scan joins and reads all chunks.
SCAN_BLOCKS = 64
SCAN_BYTES = 128 << 20
# Bytes of chunks that a task holds while it goes through several blocks, besides some four times as much for their numbers.
PIECE_BYTES = 32 << 20
# Bytes of a hit in a task's running results.
HIT_BYTES = 40
# Hits of a query that a window ranks in one task; more are ranked by ranges.
RANKED_TOGETHER = 10_000
# Hits that wait until they are merged into the running results, at least.
WAITING_ROWS = 1_024
# Queries compared per matrix product, at least, and bytes of the product with a small cell.
QUERY_STEP = 256
PRODUCT_BYTES = 4 << 20
# Bytes of a product with chunks of a batch, and how many chunks it has at least.
TILE_BYTES = 1 << 20
TILE_ROWS = 1_024
# Bytes of exact differences at a time.
REFINE_BYTES = 32 << 20

PARTIAL_SCHEMA = "query_id long, top_n long, chunk_id long, document_id long, distance double, cos double"
# What queries of stored cells carry besides.
CELL_COLUMNS = ["_cells", "_limit"]
PROFILE_SCHEMA = "query_id long, n long, least double, total double, largest double"
_PARTIAL_ARROW = pa.schema(
    [
        ("query_id", pa.int64()),
        ("top_n", pa.int64()),
        ("chunk_id", pa.int64()),
        ("document_id", pa.int64()),
        ("distance", pa.float64()),
        ("cos", pa.float64()),
    ]
)


@dataclass
class QueryBlock:
    """Queries of one block as plain arrays; a ``top_n`` below 0 means no limit."""

    query_id: np.ndarray
    vectors: np.ndarray
    top_n: np.ndarray
    filters: list[str | None]
    # hits of one query that fit a block's budget; a task emits all distances of a query that asks for more
    most: int = BLOCK_BYTES // HIT_BYTES
    # searches of stored cells: a bit for each cell, the first in the highest bit, and the largest distance of a hit
    cells: np.ndarray | None = None
    limit: np.ndarray | None = None

    @property
    def places(self) -> set:
        """What its queries are searched in: names of collections, or numbers of cells."""
        if self.cells is None:
            return set(self.filters)
        return set(np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(self.cells, axis=0))).tolist())

    @property
    def wanted(self) -> np.ndarray:
        """Hits a task keeps per query, below 0 where it emits every distance."""
        return np.where(self.top_n > self.most, -1, self.top_n)

    def sizes(self, dim: int) -> np.ndarray:
        """For each query, vector in double precision, the running results of one task, cells, and a row's overhead."""
        bits = 0 if self.cells is None else self.cells.shape[1]
        return 8 * dim + HIT_BYTES * np.maximum(self.wanted, 0) + bits + 64

    def nbytes(self, dim: int) -> int:
        return int(self.sizes(dim).sum())

    def take(self, rows: np.ndarray) -> QueryBlock:
        of = lambda column: None if column is None else column[rows]
        return QueryBlock(
            self.query_id[rows], self.vectors[rows], self.top_n[rows], [self.filters[i] for i in rows], self.most,
            of(self.cells), of(self.limit),
        )

    def split(self, dim: int, block_bytes: int) -> Iterator[QueryBlock]:
        """Blocks of about ``block_bytes``; queries with the same filter and like limits go together."""
        codes = pa.array(self.filters, pa.string()).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((self.top_n, self.wanted < 0, codes))
        ends = np.cumsum(self.sizes(dim)[order])
        starts = np.concatenate([[0], ends[:-1]])
        for rows in np.split(order, np.flatnonzero(np.diff(starts // block_bytes)) + 1):
            yield self.take(rows)

    @property
    def filtered(self) -> bool:
        return any(f is not None for f in self.filters)


def valid_queries(queries: DataFrame, dim: int) -> DataFrame:
    """Queries in kernel form: ``(query_id, embedding, top_n, filtre)``.

    Vectors of another length or with NULLs cannot be compared and are left out. Queries of stored cells keep the
    bits of their cells and the limit.
    """
    return queries.filter(dim_ok(F.col("embedding"), dim)).select(
        F.col("query_id").cast("long"),
        "embedding",
        F.col("top_n").cast("int"),
        optional_filter(F.col("filtre")).alias("filtre"),
        *[c for c in CELL_COLUMNS if c in queries.columns],
    )


def vectors_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``n x dim`` numbers of a list column, and which rows are comparable.

    All rows have ``dim`` items; a row with a NULL or a non-finite number among
    them is not comparable.
    """
    values = column.flatten()
    matrix = values.to_numpy(zero_copy_only=False).reshape(-1, dim)
    usable = np.isfinite(np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64))
    return matrix, usable


def _chunks_of(batch: pa.RecordBatch, dim: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The comparable chunks of a batch and their vectors in double precision."""
    matrix, usable = vectors_of(batch.column("embedding"), dim)
    if usable.all():
        return batch, matrix.astype(np.float64)
    kept = np.flatnonzero(usable)
    return batch.take(pa.array(kept)), matrix[kept].astype(np.float64)


def _no_queries(dim: int) -> QueryBlock:
    return QueryBlock(np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros(0, np.int64), [])


def _collect_block(queries: DataFrame, dim: int, block_bytes: int = BLOCK_BYTES) -> QueryBlock:
    """A block's queries on the driver; callers have bounded their number."""
    table = queries.toArrow().combine_chunks()
    ids = table["query_id"].to_numpy()
    if len(ids) == 0:
        return _no_queries(dim)
    cells, limit = None, None
    if set(CELL_COLUMNS) <= set(table.column_names):
        cells = np.frombuffer(b"".join(table["_cells"].to_pylist()), np.uint8).reshape(len(ids), -1)
        limit = table["_limit"].to_numpy()
    return QueryBlock(
        ids,
        vectors_of(pa.concat_arrays(table["embedding"].chunks), dim)[0],
        np.array([-1 if n is None else max(n, 0) for n in table["top_n"].to_pylist()], np.int64),
        table["filtre"].to_pylist(),
        block_bytes // HIT_BYTES,
        cells,
        limit,
    )


class _Hits:
    """Best hits so far of one step of queries, sorted by query, distance, chunk.

    New hits wait until they are as many as those kept, so a large limit is not
    sorted anew for each batch. ``limit`` is the squared distance to beat.
    """

    def __init__(self, wanted: np.ndarray, limit: np.ndarray | None = None):
        self.wanted = wanted
        self.limit = np.full(len(wanted), np.inf) if limit is None else limit
        self.columns: tuple[np.ndarray, ...] = (
            np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0),
        )
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = 0

    def add(self, *hits: np.ndarray) -> None:
        """Hits as columns: query, distance, chunk, document, cos."""
        self.waiting.append(hits)
        self.n_waiting += len(hits[0])
        if self.n_waiting > max(WAITING_ROWS, len(self.columns[0])):
            self.merge()

    def merge(self) -> None:
        merged = [np.concatenate(parts) for parts in zip(self.columns, *self.waiting)]
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((merged[2], merged[1], merged[0]))
        merged = [column[order] for column in merged]
        starts = np.searchsorted(merged[0], np.arange(len(self.wanted)))
        rank = np.arange(len(order)) - starts[merged[0]]
        keep = rank < self.wanted[merged[0]]
        self.columns = tuple(column[keep] for column in merged)
        last = keep & (rank == self.wanted[merged[0]] - 1)
        self.limit[merged[0][last]] = np.minimum(self.limit[merged[0][last]], merged[1][last] ** 2)


def _copies(matrix: np.ndarray) -> np.ndarray:
    """For every row the lowest row with the same numbers: the copies share one label.

    Rows are matched by a 64-bit hash and then compared; a row that only shares
    the hash of another stays on its own.
    """
    n = len(matrix)
    bits = np.ascontiguousarray(matrix + 0.0).view(np.uint32 if matrix.itemsize == 4 else np.uint64).reshape(n, -1)
    weights = np.random.default_rng(0).integers(1, 1 << 63, bits.shape[1], np.uint64) | np.uint64(1)
    hashes = np.empty(n, np.uint64)
    step = max(1, REFINE_BYTES // (8 * bits.shape[1]))
    for start in range(0, n, step):
        hashes[start : start + step] = (bits[start : start + step] * weights).sum(axis=1, dtype=np.uint64)
    _, first, label = np.unique(hashes, return_index=True, return_inverse=True)
    lowest = first[label]
    for start in range(0, n, step):
        rows = np.arange(start, min(start + step, n))
        rows = rows[lowest[rows] != rows]
        differ = (bits[rows] != bits[lowest[rows]]).any(axis=1)
        lowest[rows[differ]] = rows[differ]
    return lowest


def _without_spare_copies(copies: np.ndarray, chunk: np.ndarray, most: int) -> np.ndarray:
    """Rows that can be among the best ``most``: of equal vectors, the lowest chunk ids."""
    order = np.lexsort((chunk, copies))
    sorted_copies = copies[order]
    starts = np.flatnonzero(np.r_[True, sorted_copies[1:] != sorted_copies[:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return np.sort(order[rank < most])


def _exact(q, x, query_rows, chunk_rows, q_norm, x_norm):
    """Distance and cosine of the given pairs, a bounded slice at a time."""
    distance = np.empty(len(query_rows))
    cos = np.empty(len(query_rows))
    step = max(1, REFINE_BYTES // (8 * q.shape[1]))
    for start in range(0, len(query_rows), step):
        part = slice(start, start + step)
        a, b = q[query_rows[part]], x[chunk_rows[part]]
        distance[part] = np.sqrt(((a - b) ** 2).sum(axis=1))
        norms = np.sqrt(q_norm[query_rows[part]]) * np.sqrt(x_norm[chunk_rows[part]])
        product = np.einsum("ij,ij->i", a, b)
        cos[part] = np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
    return distance, cos


def _rows_by_name(names: pa.Array) -> dict[str, np.ndarray]:
    encoded = names.dictionary_encode()
    codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[order], np.arange(len(encoded.dictionary) + 1))
    return {
        name: np.sort(order[edges[i] : edges[i + 1]]) for i, name in enumerate(encoded.dictionary.to_pylist())
    }


def _groups(block: QueryBlock) -> list[tuple[str | None, np.ndarray]]:
    """Queries with the same filter and the same kind of limit, in bounded steps."""
    rows: dict[tuple, list[int]] = {}
    wanted = block.wanted
    for i, key in enumerate(zip(block.filters, (wanted < 0).tolist())):
        if wanted[i] != 0:
            rows.setdefault(key, []).append(i)
    return [
        (key[0], np.array(members[start : start + QUERY_STEP]))
        for key, members in rows.items()
        for start in range(0, len(members), QUERY_STEP)
    ]


class _Chunks:
    """The comparable chunks of a batch and what all blocks need of them, computed once."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        self.batch, self.x = _chunks_of(batch, dim)
        self._named: dict[str | None, _Operand] = {}

    @cached_property
    def copies(self) -> np.ndarray:
        return _copies(self.x)

    @cached_property
    def rows_by_name(self) -> dict[str, np.ndarray]:
        return _rows_by_name(self.batch.column("collection_name"))

    def named(self, name: str | None) -> _Operand | None:
        """Chunks of a collection, or all; None if there are none."""
        if name not in self._named:
            rows = np.arange(len(self.x)) if name is None else self.rows_by_name.get(name)
            if rows is None:
                return None
            x = self.x if name is None else self.x[rows]
            chunk, document = (self.batch.column(c).to_numpy()[rows] for c in ("chunk_id", "document_id"))
            norm = (x**2).sum(axis=1)
            self._named[name] = _Operand(rows, x, chunk, document, norm, np.column_stack([x, np.ones(len(x)), norm]))
        return self._named[name]


@dataclass
class _Operand:
    """Chunks to compare; a row of ``factors`` times ``-2q, |q|^2, 1`` of a query is their squared distance, up to rounding."""

    rows: np.ndarray
    x: np.ndarray
    chunk: np.ndarray
    document: np.ndarray
    norm: np.ndarray
    factors: np.ndarray


def _over_blocks(
    shared: list[Broadcast], work: Callable, dim: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work(block, chunks, state)`` over a task's chunks, with a state of each block's own.

    A single block sees the chunks of all batches at once. Several see them piece by piece,
    and a worker holds one of the blocks at a time.
    """

    def usable(batches) -> Iterator[_Chunks]:
        return (chunks for batch in batches if len((chunks := _Chunks(batch, dim)).x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[dict] = [{} for _ in shared]
        for piece in [usable(batches)] if len(shared) == 1 else map(list, map(usable, _pieces(batches))):
            for broadcast, state in zip(shared, states):
                yield from work(broadcast.value, piece, state)
                if len(shared) > 1:
                    vars(broadcast).pop("_value", None)  # the worker's copy; the executor's file stays

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    piece, size = [], 0
    for batch in batches:
        piece.append(batch)
        size += batch.nbytes
        if size >= PIECE_BYTES:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def _emitted(queries: QueryBlock, query, distance, chunk, document, cos) -> pa.RecordBatch:
    columns = (queries.query_id[query], queries.top_n[query], chunk, document, distance, cos)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_PARTIAL_ARROW)


def _partial_top_k(dim: int) -> Callable:
    slack = 8 * (dim + 8) * np.finfo(np.float64).eps

    def work(queries: QueryBlock, pieces, state: dict) -> Iterator[pa.RecordBatch]:
        wanted = queries.wanted
        groups = []
        for g, (name, members) in enumerate(_groups(queries)):
            q = queries.vectors[members].astype(np.float64)
            q_norm = (q**2).sum(axis=1)
            factors = np.column_stack([-2.0 * q, q_norm, np.ones(len(q))])
            groups.append((name, members, _Hits(wanted[members], state.get(g)), q, q_norm, factors))

        for chunks in pieces:
            for name, members, best, q, q_norm, factors in groups:
                c = chunks.named(name)
                if c is None:
                    continue
                most = int(best.wanted.max())
                if most < 0:
                    for i in range(len(members)):
                        query = np.full(len(c.x), i)
                        distance, cos = _exact(q, c.x, query, np.arange(len(c.x)), q_norm, c.norm)
                        yield _emitted(queries, members[query], distance, c.chunk, c.document, cos)
                    continue
                # The matrix product only preselects: whatever lies within its
                # rounding error of the current limit is measured exactly.
                error = slack * (q_norm + c.norm.max())
                step = max(TILE_ROWS, TILE_BYTES // (8 * len(members)))
                for start in range(0, len(c.x), step):
                    rough = factors @ c.factors[start : start + step].T
                    if most < rough.shape[1] and (no_limit := np.flatnonzero(np.isinf(best.limit))).size:
                        smallest = np.partition(rough[no_limit], most - 1, axis=1)[:, most - 1]
                        best.limit[no_limit] = smallest + error[no_limit]
                    query, row = np.divmod(np.flatnonzero(rough <= (best.limit + error)[:, None]), rough.shape[1])
                    row += start
                    if len(query) > 4 * most * len(members) + 1024:
                        # far more than wanted: copies of one vector tie with each other
                        tile = slice(start, start + step)
                        needed = np.zeros(len(c.x), bool)
                        needed[start + _without_spare_copies(chunks.copies[c.rows[tile]], c.chunk[tile], most)] = True
                        query, row = query[needed[row]], row[needed[row]]
                    if len(query):
                        distance, cos = _exact(q, c.x, query, row, q_norm, c.norm)
                        best.add(query, distance, c.chunk[row], c.document[row], cos)

        for g, (_, members, best, *_) in enumerate(groups):
            if best.waiting:
                best.merge()
            state[g] = best.limit
            if len(best.columns[0]):
                yield _emitted(queries, members[best.columns[0]], *best.columns[1:])

    return work


def _partial_in_cells(dim: int) -> Callable:
    """As ``_partial_top_k``, but a query meets only chunks of cells whose bit it has, within its limit.

    A query has one running result for all its cells of a task, so what is emitted grows with the hits and not with
    the cells read.
    """
    slack = 8 * (dim + 8) * np.finfo(np.float64).eps

    def work(queries: QueryBlock, pieces, state: dict) -> Iterator[pa.RecordBatch]:
        if not len(queries.query_id):
            return
        wanted = queries.wanted
        best = _Hits(np.maximum(wanted, 0), state["limit"] if state else queries.limit**2)
        for chunks in pieces:
            batch, x_all = chunks.batch, chunks.x
            chunk_all = batch.column("chunk_id").to_numpy()
            document_all = batch.column("document_id").to_numpy()
            cell_all = batch.column("cell").to_numpy()
            by_cell = np.argsort(cell_all, kind="stable")
            edges = np.flatnonzero(np.diff(cell_all[by_cell], prepend=-1, append=-1))
            for rows in np.split(by_cell, edges[1:-1]):
                cell = int(cell_all[rows[0]])
                asking = np.flatnonzero(queries.cells[:, cell >> 3] >> (7 - cell % 8) & 1)
                x, chunk, document = x_all[rows], chunk_all[rows], document_all[rows]
                x_norm = (x**2).sum(axis=1)
                copies = None
                for i in asking[wanted[asking] < 0]:
                    q = queries.vectors[i : i + 1].astype(np.float64)
                    distance, cos = _exact(q, x, np.zeros(len(x), np.int64), np.arange(len(x)), (q**2).sum(axis=1), x_norm)
                    near = np.flatnonzero(~(distance > queries.limit[i]))
                    yield _emitted(queries, np.full(len(near), i), distance[near], chunk[near], document[near], cos[near])
                asking = asking[wanted[asking] > 0]
                step = max(QUERY_STEP, PRODUCT_BYTES // (8 * len(x)))
                for start in range(0, len(asking), step):
                    members = asking[start : start + step]
                    most = int(wanted[members].max())
                    q = queries.vectors[members].astype(np.float64)
                    q_norm = (q**2).sum(axis=1)
                    rough = q_norm[:, None] + x_norm[None, :] - 2.0 * (q @ x.T)
                    error = slack * (q_norm + x_norm.max())
                    limit = best.limit[members]
                    if most < len(x) and (no_limit := np.flatnonzero(np.isinf(limit))).size:
                        smallest = np.partition(rough[no_limit], most - 1, axis=1)[:, most - 1]
                        limit[no_limit] = smallest + error[no_limit]
                    query, row = np.nonzero(rough <= (limit + error)[:, None])
                    if len(query) > 4 * most * len(members) + 1024:
                        copies = _copies(x) if copies is None else copies
                        needed = np.zeros(len(x), bool)
                        needed[_without_spare_copies(copies, chunk, most)] = True
                        query, row = query[needed[row]], row[needed[row]]
                    if len(query):
                        distance, cos = _exact(q, x, query, row, q_norm, x_norm)
                        best.add(members[query], distance, chunk[row], document[row], cos)
        if best.waiting:
            best.merge()
        state["limit"] = best.limit
        if len(best.columns[0]):
            yield _emitted(queries, *best.columns)

    return work


def query_blocks(queries: DataFrame, dim: int, block_bytes: int) -> Iterator[QueryBlock]:
    """All valid queries as blocks of about ``block_bytes``; a single one when they fit."""
    # counted before any vector is computed; an encoder's column is pruned here
    fits = queries.count() * (8 * dim + 64) <= block_bytes
    queries = valid_queries(queries, dim)
    if fits:
        block = _collect_block(queries, dim, block_bytes)
        if block.nbytes(dim) <= block_bytes:
            yield block
            return
    spark, path = queries.sparkSession, scratch_path(queries.sparkSession, "queries")
    queries = materialise(queries, "queries-encoded")  # encode the texts once
    tracked = F.when(F.col("top_n") * F.lit(HIT_BYTES).cast("long") <= block_bytes, F.greatest("top_n", F.lit(0))).otherwise(0)
    bits = F.length("_cells").cast("long") if "_cells" in queries.columns else F.lit(0)
    total = queries.agg(F.sum(8 * dim + HIT_BYTES * F.coalesce(tracked, F.lit(0)).cast("long") + bits + 64)).first()[0]
    # a folder for each block, or for as many small blocks as the driver may hold: each folder is a job
    folders = -(-int(total or 0) // max(block_bytes, BLOCK_BYTES))
    dealt = queries.withColumn("folder", F.pmod(F.xxhash64("query_id"), F.lit(folders)).cast("int"))
    dealt.write.partitionBy("folder").parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path)
    for i in range(folders):
        block = _collect_block(stored.filter(F.col("folder") == i).drop("folder"), dim, block_bytes)
        if len(block.query_id):
            yield from block.split(dim, block_bytes) if block_bytes < BLOCK_BYTES else [block]


def knn(
    queries: DataFrame,
    candidates: Callable[[set[str | None]], DataFrame],
    dim: int,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Best ``top_n`` chunks per query: ``query_id, chunk_id, document_id, distance, cos, rk``.

    ``candidates(filters)`` gives the chunks to compare for some blocks of
    queries, with a ``collection_name`` when some query filters on one.
    """
    parts, limits = partial_results(queries, candidates, dim, block_bytes)
    return rank_hits(parts, limits).drop("top_n")


def partial_results(
    queries: DataFrame, candidates: Callable[[set], DataFrame], dim: int, block_bytes: int = BLOCK_BYTES, in_cells: bool = False
) -> tuple[DataFrame, set[int]]:
    """Hits of all tasks before they are ranked, and the limits that occur among the queries.

    ``in_cells``: queries carry ``CELL_COLUMNS``, and ``candidates`` takes numbers of cells and gives chunks with their ``cell``.
    """
    columns = ["chunk_id", "document_id", "embedding"] + ["cell"] * in_cells
    work = _partial_in_cells(dim) if in_cells else _partial_top_k(dim)
    return _by_block(queries, candidates, dim, block_bytes, PARTIAL_SCHEMA, columns, work)


def rank_hits(parts: DataFrame, limits: set[int]) -> DataFrame:
    """Partial results with their rank ``rk``, at most ``top_n`` for each query; ``limits`` are all that occur."""
    best_first = [F.asc_nulls_last("distance"), F.col("chunk_id").asc()]
    many = [n for n in limits if n < 0 or n > RANKED_TOGETHER]
    few = [n for n in limits if 0 <= n <= RANKED_TOGETHER]
    is_few = F.col("top_n").between(0, RANKED_TOGETHER)
    if many and few:
        parts = materialise(parts, "partial")
    ranked = (parts.filter(is_few) if many else parts).withColumn(
        "rk", F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first))
    )
    # a literal bound lets Spark prune each task's rows before the shuffle
    ranked = ranked.filter(F.col("rk") <= max(few, default=0))
    if many:
        wide = rank_in_groups(parts.filter(~is_few), ["query_id"], best_first, "ranked")
        ranked = ranked.unionByName(wide) if few else wide
    return ranked.filter((F.col("top_n") < 0) | (F.col("rk") <= F.col("top_n")))


def _by_block(
    queries: DataFrame, candidates: Callable[[set], DataFrame], dim: int, block_bytes: int, schema: str,
    columns: list[str], work: Callable,
) -> tuple[DataFrame, set[int]]:
    """Partial results of all blocks, and the limits that occur among the queries.

    One block stays lazy. Of several, up to ``SCAN_BLOCKS`` share a scan, or more that have ``SCAN_BYTES`` together;
    its result is written, and then the executors give up their copies.
    """
    spark = queries.sparkSession

    def scan(shared: list[Broadcast], filters: set, filtered: bool) -> DataFrame:
        rows = candidates(filters)
        if not filters:
            rows = rows.filter(F.lit(False))  # nothing asked, nothing read
        read = columns + (["collection_name"] if filtered else [])
        chosen = rows.select(*[F.col(c).cast("long") if c.endswith("_id") else F.col(c) for c in read])
        return chosen.mapInArrow(_over_blocks(shared, work, dim), schema)

    blocks = query_blocks(queries, dim, block_bytes)
    first = list(islice(blocks, 2)) or [_no_queries(dim)]
    if len(first) == 1:
        return scan([spark.sparkContext.broadcast(first[0])], first[0].places, first[0].filtered), set(first[0].top_n.tolist())
    path, blocks = scratch_path(spark, "partial"), chain(first, blocks)
    limits: set[int] = set()
    first, n_scans = None, 0
    while True:
        shared, filters, filtered = [], set(), False
        for block in islice(blocks, max(SCAN_BLOCKS, SCAN_BYTES // block_bytes)):
            limits.update(block.top_n.tolist())
            filters.update(block.places)
            filtered |= block.filtered
            shared.append(spark.sparkContext.broadcast(block))
        if not shared:
            return spark.read.schema(schema + ", scan int").parquet(path).drop("scan"), limits
        scan(shared, filters, filtered).write.parquet(f"{path}/scan={n_scans}")
        for broadcast in shared:
            broadcast.destroy()
        n_scans += 1


def distance_profile(queries: DataFrame, candidates: Callable[[set[str | None]], DataFrame], dim: int) -> DataFrame:
    """Candidates of each query and the least, mean and largest distance to them.

    The whole query-by-chunk comparison as an aggregate: tasks emit one partial
    row per query, so the pairs themselves are never written or shuffled.
    """

    merged, _ = _by_block(queries, candidates, dim, BLOCK_BYTES, PROFILE_SCHEMA, ["embedding"], _partial_profile(dim))
    return merged.groupBy("query_id").agg(
        F.sum("n").alias("n_candidates"),
        F.min("least").alias("min_distance"),
        (F.sum("total") / F.sum("n")).alias("mean_distance"),
        F.max("largest").alias("max_distance"),
    )


def _partial_profile(dim: int) -> Callable:
    def work(queries: QueryBlock, pieces, state: dict) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(queries.query_id), np.int64)
        least, total, largest = np.full(len(n), np.inf), np.zeros(len(n)), np.zeros(len(n))
        members_by_name: dict[str | None, list[int]] = {}
        for i, name in enumerate(queries.filters):
            members_by_name.setdefault(name, []).append(i)
        for chunks in pieces:
            for name, members in members_by_name.items():
                rows = np.arange(len(chunks.x)) if name is None else chunks.rows_by_name.get(name)
                if rows is None:
                    continue
                # copies are measured once and counted as often as they occur
                first, times = np.unique(chunks.copies[rows], return_counts=True)
                x = chunks.x[first]
                x_norm = (x**2).sum(axis=1)
                for start in range(0, len(members), QUERY_STEP):
                    step = np.array(members[start : start + QUERY_STEP])
                    q = queries.vectors[step].astype(np.float64)
                    q_norm = (q**2).sum(axis=1)
                    squared = q_norm[:, None] + x_norm[None, :] - 2.0 * (q @ x.T)
                    # the product cancels for near-equal vectors: measure those exactly
                    near = np.nonzero(squared < 1e-3 * (q_norm[:, None] + x_norm[None, :]))
                    distance = np.sqrt(np.maximum(squared, 0.0))
                    distance[near], _ = _exact(q, x, *near, q_norm, x_norm)
                    n[step] += times.sum()
                    least[step] = np.minimum(least[step], distance.min(axis=1))
                    total[step] += distance @ times
                    largest[step] = np.maximum(largest[step], distance.max(axis=1))
        seen = n > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[seen]) for c in (queries.query_id, n, least, total, largest)],
            names=["query_id", "n", "least", "total", "largest"],
        )

    return work
