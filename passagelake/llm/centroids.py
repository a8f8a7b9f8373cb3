"""Centroid clustering by N-simplex projection: exact integer k-means whose distances are mostly never computed.

A few of the first centroids serve as pivots. Every vector's squared distances to them are computed once and
stored. They fix the vector's apex: its place above the simplex that the pivots span, as coordinates within the
simplex and an altitude over it. Between two apexes the Euclidean distance is at least the one with both
altitudes on the same side and at most the one with them on opposite sides. A centroid whose lower bound exceeds
the smallest upper bound of a vector is not compared; the rest is compared in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.common import map_batches
from passagelake.session import materialise

DIM, CLUSTERS, ROUNDS = 64, 16, 3
#: Components are multiplied by this and rounded down.
STEP = 64
#: Largest component after that, in absolute value: squared distances then fit a long.
LARGEST = 1 << 27
#: Most pivots, and the least altitude of a pivot over those before it as a share of the largest distance between
#: candidates. Flatter simplexes would magnify rounding errors.
PIVOTS, LEAST_ALTITUDE = 12, 0.2
#: Share of the largest squared distance by which rounding may move a bound: with altitudes of a fifth, eleven
#: substitutions magnify an error of 1e-16 to some 1e-8 at most.
SLACK = 1e-6


class Simplex:
    """The simplex that some pivots span, and the apexes of other points over it."""

    def __init__(self, candidates: np.ndarray):
        """Takes up to ``PIVOTS`` of the candidates, always the one that is highest above those taken."""
        taken, rest = [0], (candidates - candidates[0]).astype(float)
        highest = np.sqrt((rest**2).sum(axis=1).max())
        while len(taken) < PIVOTS:
            height = np.sqrt((rest**2).sum(axis=1))
            k = int(height.argmax())
            if height[k] <= LEAST_ALTITUDE * highest:
                break
            taken.append(k)
            axis = rest[k] / height[k]
            rest = rest - np.outer(rest @ axis, axis)
        self.pivots = candidates[taken]
        edges = self.pivots[1:] - self.pivots[0]
        gram = (edges @ edges.T).astype(float)
        self.edges = np.diag(gram).copy()
        self.base = np.linalg.cholesky(gram) if len(edges) else np.zeros((0, 0))

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots."""
        return np.stack([((points - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)

    def apexes(self, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates within the simplex, and altitude over it."""
        squared = squared.astype(float)
        sides = (squared[:, :1] + self.edges - squared[:, 1:]) / 2
        within = np.linalg.solve(self.base, sides.T).T if len(self.base) else sides
        return within, np.sqrt(np.maximum(squared[:, 0] - (within**2).sum(axis=1), 0))


def assign(simplex: Simplex, points: np.ndarray, squared: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every point (of equals the first), its squared distance, and how many were compared.

    ``squared`` holds the points' stored distances to the pivots.
    """
    to_centroids = simplex.distances(centroids)
    (within, height), (at, up) = simplex.apexes(squared), simplex.apexes(to_centroids)
    flat = ((within[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
    lower, upper = flat + (height[:, None] - up) ** 2, flat + (height[:, None] + up) ** 2
    slack = SLACK * (squared.max(axis=1) + to_centroids.max()).astype(float)
    open_ = lower <= (upper.min(axis=1) + slack)[:, None]
    exact = np.full(open_.shape, np.iinfo(np.int64).max)
    for k, centroid in enumerate(centroids):
        rows = np.flatnonzero(open_[:, k])
        exact[rows, k] = ((points[rows] - centroid) ** 2).sum(axis=1)
    nearest = exact.argmin(axis=1)
    return nearest, exact[np.arange(len(points)), nearest], int(open_.sum())


def whole_numbers(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """``vec_id, point`` of the usable vectors, their components as integers."""
    usable = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST / STEP, F.lit(False)))
    point = F.transform("embedding", lambda x: F.floor(x.cast("double") * STEP).cast("int"))
    return rows.where((F.size("embedding") == dim) & usable).select(F.col("vec_id").cast("long"), point.alias("point"))


def first_centroids(points: DataFrame, clusters: int = CLUSTERS, seed: str = "1") -> np.ndarray:
    """Points with the smallest SHA-256 of ``seed:vec_id``; at most ``clusters`` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.where("vec_id is not null").orderBy(key, "point").limit(clusters).collect()
    return np.array([r.point for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def cluster(rows: DataFrame, dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "1") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` of every usable vector.

    Needs ``vec_id, embedding``; other columns are left out. Left out are vectors of another length, with a null
    or a non-finite component, and with one of 2,097,152 or more, whose distances would not fit a long. Repeated
    rows count each. A row without ``vec_id`` is assigned but never a first centroid; if no row has one, or no
    vector is usable, there are no rows. An inertia beyond a long is null. With fewer usable vectors than clusters
    there are as many clusters as vectors. Equal distances go to the smaller cluster.

    Only centroids, and sums by cluster and component, reach the driver.
    """
    spark = rows.sparkSession
    points = whole_numbers(rows, dim)
    centroids = first_centroids(points, clusters, seed)
    if not len(centroids):
        nothing = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>"
        return spark.createDataFrame([], nothing)
    simplex = Simplex(centroids)
    n_pivots = len(simplex.pivots)

    def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = pa.array(simplex.distances(_matrix(batch.column("point"), dim)).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_pivots), far)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "point", "far"])

    cached = materialise(map_batches(points, cache, "vec_id long, point array<int>, far array<long>"), "centroids-cached")
    for _ in range(rounds):
        centroids = _moved(cached, simplex, centroids, dim)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, distance, _ = assign(simplex, _matrix(batch.column("point"), dim), _matrix(batch.column("far"), n_pivots), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    labelled = materialise(map_batches(cached, label, "vec_id long, cluster int, distance long"), "centroids-labelled")
    sums = {r.cluster: int(r.s) for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    found = [(k, fits(sums[k]), fits(sum(sums.values())), centroids[k].tolist()) for k in sums]
    each = spark.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return labelled.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # one row a cluster


def _moved(cached: DataFrame, simplex: Simplex, centroids: np.ndarray, dim: int) -> np.ndarray:
    """Centroids after one round: the floor of the mean of their points; those without points stay."""
    n_pivots = len(simplex.pivots)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for batch in batches:
            points = _matrix(batch.column("point"), dim)
            nearest, _, _ = assign(simplex, points, _matrix(batch.column("far"), n_pivots), centroids)
            for k in np.unique(nearest):
                mine = points[nearest == k]
                count[k] += len(mine)
                total[k] += mine.sum(axis=0)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(count[seen]), pa.array(total[seen].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = map_batches(cached.select("point", "far"), sums, "cluster int, n long, total array<long>")
    exact = F.sum(F.col("x").cast("decimal(38,0)")).alias("s")
    merged = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), exact)
    out = centroids.copy()
    for r in merged.collect():  # one row for each cluster and component
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out
