import random
from hashlib import sha256

import numpy as np
import pytest
from conftest_llm import SMALL
from passagelake.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, dim, clusters, rounds):
    """Plain integer k-means over ``(vec_id, floats)``; rows come back as ``(vec_id, cluster, distance, ...)``."""
    kept = [(v, [int(np.floor(64 * np.float64(x))) for x in e]) for v, e in rows if e is not None and len(e) == dim and all(x is not None and abs(x) < 2097152 for x in e)]
    order = sorted((sha256(f"1:{v}".encode()).hexdigest(), p) for v, p in kept if v is not None)
    middle = [p for _, p in order[:clusters]]
    if not middle:
        return []

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), k) for k, c in enumerate(middle))

    for _ in range(rounds):
        mine = [nearest(p)[1] for _, p in kept]
        for k in range(len(middle)):
            own = [p for (_, p), m in zip(kept, mine, strict=True) if m == k]
            if own:
                middle[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(p) for _, p in kept]
    total = sum(d for d, _ in last)
    by = {k: sum(d for d, m in last if m == k) for k in range(len(middle))}
    return sorted(((v, k, d, by[k], total, middle[k]) for (v, _), (d, k) in zip(kept, last, strict=True)), key=str)


def found(df, **how):
    return sorted((tuple(r) for r in centroids.cluster(df, **how).collect()), key=str)


def test_equals_plain_k_means(spark):
    rng = random.Random(1)
    means = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(means)]) for i in range(400)]
    rows += [(400 + i, [0.0] * 6) for i in range(300)]  # a third of the vectors are the same
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    as_float = [(i, np.array(e, np.float32).tolist()) for i, e in rows]
    assert found(df, dim=6, clusters=7, rounds=3) == brute(as_float, 6, 7, 3)


def test_query_equals_plain_k_means(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = [(*r[:5], sha256(",".join(map(str, r[5])).encode()).hexdigest()) for r in brute(rows, 64, 16, 3)]
    assert sorted((tuple(r) for r in queries.op13_centroids(spark, SMALL).collect()), key=str) == want


@pytest.mark.parametrize("scale", [1, 50, 1 << 26])
def test_bounds_hold_and_filter(scale):
    rng = np.random.default_rng(2)
    middle = rng.integers(-scale, scale + 1, (16, 64))
    points = np.concatenate([np.clip(np.repeat(middle, 20, axis=0) + rng.integers(-scale // 8, scale // 8 + 1, (320, 64)), -centroids.LARGEST, centroids.LARGEST), middle])
    simplex = centroids.Simplex(middle)
    nearest, distance, compared = centroids.assign(simplex, points, simplex.distances(points), middle)
    exact = ((points[:, None, :] - middle) ** 2).sum(axis=2)
    assert (nearest == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    if scale > 1:
        assert compared < 0.3 * exact.size
    # each bound on its own side of the true distance
    (within, height), (at, up) = simplex.apexes(simplex.distances(points)), simplex.apexes(simplex.distances(middle))
    flat = ((within[:, None, :] - at) ** 2).sum(axis=2)
    margin = centroids.SLACK * exact.max()
    assert (flat + (height[:, None] - up) ** 2 <= exact + margin).all() and (flat + (height[:, None] + up) ** 2 >= exact - margin).all()


def test_flat_and_equal_candidates_make_a_small_simplex():
    line = np.outer(np.arange(10), np.ones(8, np.int64))
    assert len(centroids.Simplex(line).pivots) == 2
    same = centroids.Simplex(np.ones((5, 8), np.int64))
    points = np.arange(24).reshape(3, 8)
    nearest, distance, _ = centroids.assign(same, points, same.distances(points), np.ones((5, 8), np.int64))
    assert nearest.tolist() == [0, 0, 0] and distance.tolist() == ((points - 1) ** 2).sum(axis=1).tolist()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]),
        (9, [3e38, 0.0]), (None, [-0.01, 2.0]), (None, None), (10, [-4.0, -0.0]), (11, [1.0, 2.0, 3.0]), (12, [2097151.0, -2097151.0]),
    ]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).selectExpr("*", "'x' AS cluster", "'x' AS point", "'x' AS far", "'x' AS distance")
    assert found(df, dim=2, clusters=3, rounds=2) == brute(rows, 2, 3, 2)
    assert found(df, dim=2, clusters=16) == brute(rows, 2, 16, 3)
    assert found(df.where("vec_id > 2 AND vec_id < 10"), dim=2) == [] == found(df.where("vec_id is null"), dim=2)
