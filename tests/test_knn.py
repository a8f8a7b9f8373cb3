import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.operators import knn as knn_module
from passagelake.operators import search
from passagelake.operators.ranking import rank_in_groups
from passagelake.functions import vectors
from passagelake.session import scratch_path
from passagelake.sources import sinks

DIM = 8


def tables(spark, vectors_, documents=None, collection=lambda d: d % 3 + 1):
    n = len(vectors_)
    chunks = spark.createDataFrame(
        [(i, i % 7, f"text {i}", None if v is None else [None if x is None else float(x) for x in v], collection(i % 7))
         for i, v in enumerate(vectors_)],
        "chunk_id long, document_id long, chunk_text string, embedding array<float>, collection_id int",
    ).repartition(4)
    docs = spark.createDataFrame([(d, collection(d)) for d in documents or range(6)], "document_id long, collection_id int")
    # two owners use the name "a"
    cols = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "collection_id int, name string")
    assert n
    return chunks, docs, cols


def requests(spark, rows):
    return spark.createDataFrame(rows, "query_id long, embedding array<float>, top_n int, filtre string")


def brute(vectors_, rows, documents=range(6), collection=lambda d: d % 3 + 1, names={1: "a", 2: "b", 3: "a"}):
    out = {}
    for qid, q, top_n, filtre in rows:
        if len(q) != DIM:
            continue
        q = np.array(q, np.float32).astype(float)
        wanted = None if filtre in (None, "", "string") else filtre
        hits = []
        for i, v in enumerate(vectors_):
            if v is None or len(v) != DIM or any(x is None for x in v) or not np.isfinite(v).all() or i % 7 not in documents:
                continue
            if wanted is not None and names[collection(i % 7)] != wanted:
                continue
            x = np.array(v, np.float32).astype(float)
            hits.append((np.sqrt(((q - x) ** 2).sum()), i))
        hits.sort()
        for rank, (d, i) in enumerate(hits if top_n is None else hits[: max(top_n, 0)], 1):
            out[qid, rank] = (i, round(float(d), 6))
    return out


def found(df):
    return {(r.query_id, r.rk): (r.chunk_id, round(r.distance, 6)) for r in df.collect()}


def sample(seed=0, n=400):
    rng = np.random.default_rng(seed)
    data = [list(map(float, v)) for v in rng.normal(size=(n, DIM)) * rng.uniform(0.1, 20, size=(n, 1))]
    data[3] = None
    data[5] = data[5][:-1]
    data[6] = [0.0] * DIM
    data[8] = [None] + data[8][1:]
    data[9] = [float("nan")] + data[9][1:]
    data[10] = [float("inf")] + data[10][1:]
    for i in range(n // 2, n // 2 + n // 3):  # a third are copies of one vector
        data[i] = data[19]
    return data


ROWS = [
    (0, 5, None), (1, 1, ""), (2, 7, "string"), (3, 4, "a"), (4, 6, "b"), (5, 3, "missing"), (6, None, None),
    (7, None, "b"), (8, 0, None), (9, 200, None), (10, 10_000, "a"), (11, -1, None),
]


def asked(data, rows=ROWS):
    return [(qid, data[19] if qid % 2 else data[20 + qid], top_n, filtre) for qid, top_n, filtre in rows] + [
        (99, [1.0] * (DIM - 1), 5, None)
    ]


@pytest.mark.parametrize("block_bytes", [1 << 28, 150_000])
def test_equals_brute_force(spark, block_bytes):
    data = sample()
    rows = asked(data)
    got = search.topk_search_batch(requests(spark, rows), *tables(spark, data), DIM, block_bytes=block_bytes)
    assert found(got) == brute(data, rows)


@pytest.mark.parametrize("limit, with_collection", [(0, True), (0, False), (2, True), (2, False)])
def test_every_join_path_gives_the_same(spark, monkeypatch, limit, with_collection):
    """Small documents, few missing documents, and neither."""
    data = sample(1, 150)
    rows = asked(data)
    chunks, docs, cols = tables(spark, data)
    if not with_collection:
        chunks = chunks.drop("collection_id")
    monkeypatch.setattr(search, "BROADCAST_ROWS", limit)
    assert found(search.topk_search_batch(requests(spark, rows), chunks, docs, cols, DIM)) == brute(data, rows)
    plain = [r for r in rows if r[3] is None]
    assert found(search.topk_search_batch(requests(spark, plain), chunks, docs, cols, DIM)) == brute(data, plain)
    only = [r for r in rows if r[3] == "a"]
    assert found(search.topk_search_batch(requests(spark, only), chunks, docs, cols, DIM)) == brute(data, only)


@pytest.mark.parametrize("limit", [0, 2, 500_000])
def test_documents_decide_at_every_size(spark, monkeypatch, limit):
    """A stale collection in a chunk row and a repeated document change nothing, however large the catalog is."""
    data = sample(3, 60)
    chunks, docs, cols = tables(spark, data)
    stale = chunks.withColumn("collection_id", F.lit(999))
    rows = asked(data)
    want = brute(data, rows)
    monkeypatch.setattr(search, "BROADCAST_ROWS", limit)
    assert found(search.topk_search_batch(requests(spark, rows), stale, docs.unionAll(docs.limit(1)), cols, DIM)) == want
    only = [r for r in rows if r[3] == "a"]
    assert found(search.topk_search_batch(requests(spark, only), stale, docs.unionAll(docs.limit(1)), cols, DIM)) == brute(data, only)


def test_filtered_search_reads_the_wanted_folders_only(spark):
    data = sample(4, 80)
    chunks, docs, cols = tables(spark, data)
    root = scratch_path(spark, "laid-out")
    named = chunks.drop("collection_id").join(docs.select("document_id", "collection_id"), "document_id")
    sinks.sink_documents_chunks(docs, named, root, "bulk", 0)
    stored = spark.read.parquet(f"{root}/chunks")
    rows = [(0, data[20], 5, "a")]
    build = search.candidates(stored, docs, cols, DIM, placed=True)
    read = build({"a"})
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection_bucket" in plan or "PartitionFilters: [collection_bucket" in plan
    got = found(knn_module.knn(requests(spark, rows), build, DIM))
    assert got == brute(data, rows)


def test_limits_beyond_a_block_are_exact(spark):
    """A limit whose running results would not fit a block's budget: a task emits all distances instead."""
    data = sample(2, 120)
    rows = asked(data)
    chunks, docs, cols = tables(spark, data)
    block = knn_module._collect_block(knn_module.valid_queries(requests(spark, rows), DIM), DIM, 100 * knn_module.HIT_BYTES)
    assert (block.wanted[block.top_n > 100] == -1).all() and (block.wanted[block.top_n <= 100] == block.top_n[block.top_n <= 100]).all()
    assert found(search.topk_search_batch(requests(spark, rows), chunks, docs, cols, DIM, block_bytes=100 * knn_module.HIT_BYTES)) == brute(data, rows)


@pytest.mark.parametrize("together", [0, 5, 10_000])
def test_ranks_by_range_equal_ranks_by_window(spark, monkeypatch, together):
    data = sample(9, 300)
    rows = asked(data)
    monkeypatch.setattr(knn_module, "RANKED_TOGETHER", together)
    assert found(search.topk_search_batch(requests(spark, rows), *tables(spark, data), DIM)) == brute(data, rows)


def test_one_unlimited_query_is_spread_over_partitions(spark):
    """Ranks of one query come from many partitions, and no window gathers the query."""
    rows = spark.range(200_000).select(
        F.lit(7).cast("long").alias("query_id"), F.rand(1).alias("distance"), F.col("id").alias("chunk_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # or so few rows go to two partitions
    ranked = rank_in_groups(rows, ["query_id"], [F.col("distance").asc(), F.col("chunk_id").asc()], "test-rank")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in next(line for line in plan.split("\n") if "Window" in line and "row_number" in line)
    got = ranked.select("rk", "distance").toPandas().sort_values("rk")
    assert got.rk.tolist() == list(range(1, 200_001)) and got.distance.is_monotonic_increasing
    stored = ranked._jdf.inputFiles()
    assert len(list(stored)) >= 4
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")


def test_many_blocks_share_a_scan(spark, monkeypatch):
    """However many blocks there are, the chunks are read once, in pieces, and the hits stay the same."""
    data = sample(10, 300)
    rows = [(i, data[20 + i % 50], [3, 40, None, 0][i % 4], [None, "a", "b"][i % 3]) for i in range(60)]
    monkeypatch.setattr(knn_module, "PIECE_BYTES", 1)
    scans = []
    chunks, docs, cols = tables(spark, data)
    build = search.candidates(chunks, docs, cols, DIM)
    got = knn_module.knn(requests(spark, rows), lambda f: scans.append(f) or build(f), DIM, block_bytes=4_000)
    assert found(got) == brute(data, rows) and scans == [{None, "a", "b"}]
    monkeypatch.setattr(knn_module, "SCAN_BLOCKS", 2)
    assert found(search.topk_search_batch(requests(spark, rows), chunks, docs, cols, DIM, block_bytes=4_000)) == brute(data, rows)


def test_small_blocks_share_collects_and_scans(spark, monkeypatch):
    """With more than 64 blocks the driver collects once and one scan takes all of them; fewer in a scan change nothing."""
    data = sample(11, 200)
    rows = [(i, data[20 + i % 50], [3, 40, None][i % 3], [None, "a", "b"][i // 3 % 3]) for i in range(150)]
    chunks, docs, cols = tables(spark, data)
    build = search.candidates(chunks, docs, cols, DIM)
    collected, scans, collect = [], [], knn_module._collect_block
    monkeypatch.setattr(knn_module, "_collect_block", lambda *a: collected.append(collect(*a)) or collected[-1])
    got = knn_module.knn(requests(spark, rows), lambda f: scans.append(f) or build(f), DIM, block_bytes=300)
    want = brute(data, rows)
    assert found(got) == want and len(collected) == 1 and scans == [{None, "a", "b"}]
    monkeypatch.setattr(knn_module, "SCAN_BYTES", 9_000)
    monkeypatch.setattr(knn_module, "SCAN_BLOCKS", 2)
    scans.clear()
    got = knn_module.knn(requests(spark, rows), lambda f: scans.append(f) or build(f), DIM, block_bytes=300)
    assert found(got) == want and len(scans) > 1


def test_split_blocks_fit_and_keep_filters_together(spark):
    rows = [(i, [float(i)] * DIM, i % 5, [None, "a", "b"][i % 3]) for i in range(90)]
    block = knn_module._collect_block(knn_module.valid_queries(requests(spark, rows), DIM), DIM)
    parts = list(block.split(DIM, 2_000))
    assert sorted(np.concatenate([p.query_id for p in parts]).tolist()) == list(range(90))
    assert all(p.nbytes(DIM) <= 2_000 + block.sizes(DIM).max() for p in parts)
    assert sum(len(set(p.filters)) for p in parts) <= len(parts) + 2
    for p in parts:
        for i, filtre, top_n, vector in zip(p.query_id, p.filters, p.top_n, p.vectors):
            assert (filtre, top_n, vector[0]) == (rows[i][3], rows[i][2], float(i))


def test_small_tiles_equal_brute_force(spark, monkeypatch):
    """Limits carried from tile to tile and from piece to piece, ties and copies among them."""
    monkeypatch.setattr(knn_module, "TILE_ROWS", 16)
    monkeypatch.setattr(knn_module, "TILE_BYTES", 1)
    monkeypatch.setattr(knn_module, "WAITING_ROWS", 4)
    monkeypatch.setattr(knn_module, "PIECE_BYTES", 1)
    data = sample(12, 300)
    rows = asked(data) + [(100 + i, data[20 + i], 1 + i % 6, [None, "a"][i % 2]) for i in range(40)]
    for block_bytes in (1 << 28, 2_000):
        got = search.topk_search_batch(requests(spark, rows), *tables(spark, data), DIM, block_bytes=block_bytes)
        assert found(got) == brute(data, rows)


def test_running_results_are_bounded():
    """A limit of 10,001 over a million hits: what a task holds stays below three times the limit."""
    rng, most = np.random.default_rng(0), 10_001
    best, every, held = knn_module._Hits(np.array([most])), [], 0
    for start in range(0, 1_000_000, 10_000):
        distance = rng.random(10_000)
        every.append(distance)
        chosen = np.flatnonzero(distance**2 <= best.limit[0])
        ids = start + chosen
        best.add(np.zeros(len(ids), np.int64), distance[chosen], ids, ids, distance[chosen])
        held = max(held, best.n_waiting + len(best.columns[0]))
    best.merge()
    assert held <= 3 * most and len(best.columns[0]) == most
    assert (best.columns[1] == np.sort(np.concatenate(every))[:most]).all()


def test_ties_go_to_the_lower_chunk_id(spark):
    data = [[1.0] * DIM] * 30
    rows = [(0, [0.0] * DIM, 4, None)]
    got = search.topk_search_batch(requests(spark, rows), *tables(spark, data), DIM).orderBy("rk").collect()
    assert [r.chunk_id for r in got] == [0, 1, 2, 3]


def test_l2_order_is_not_cosine_order(spark):
    data = [[10.0] + [0.0] * 7, [0.6, 0.8] + [0.0] * 6]
    rows = [(0, [1.0] + [0.0] * 7, 2, None)]
    got = search.topk_search_batch(requests(spark, rows), *tables(spark, data), DIM).orderBy("rk").collect()
    assert [(r.chunk_id, round(r.cos, 6)) for r in got] == [(1, 0.6), (0, 1.0)]


def test_zero_vector_has_cosine_zero(spark):
    rows = [(0, [0.0] * DIM, 1, None)]
    got = search.topk_search_batch(requests(spark, rows), *tables(spark, [[1.0] * DIM]), DIM).first()
    assert got.cos == 0.0


def test_no_queries_and_no_hits(spark):
    chunks, docs, cols = tables(spark, sample(3, 60))
    assert search.topk_search_batch(requests(spark, []), chunks, docs, cols, DIM).count() == 0
    assert search.search([1.0] * DIM, chunks, docs, cols, filtre="missing", dim=DIM).count() == 0
    assert search.search([1.0] * DIM, chunks, docs, cols, top_n=0, dim=DIM).count() == 0


def test_single_request_is_ordered(spark):
    data = sample(4, 80)
    data[20] = [float(x) for x in np.array(data[20], np.float32)]
    got = search.search(data[20], *tables(spark, data), top_n=None, dim=DIM).collect()
    assert [(r.chunk_id, round(r.distance, 6)) for r in got] == [
        v for _, v in sorted(brute(data, [(0, data[20], None, None)]).items())
    ]


def test_expressions_agree_with_kernel(spark):
    data = [v for v in sample(5, 60) if v and len(v) == DIM and None not in v and np.isfinite(v).all()]
    q = data[11]
    chunks, docs, cols = tables(spark, data)
    kernel = {r.chunk_id: (r.distance, r.cos) for r in search.search(q, chunks, docs, cols, None, dim=DIM).collect()}
    # the request is given in double precision, the chunks in single
    request = F.array(*[F.lit(float(x)) for x in q])
    for r in chunks.select(
        "chunk_id", vectors.l2_distance(F.col("embedding"), request).alias("d"),
        vectors.cosine_similarity(F.col("embedding"), request).alias("c"),
    ).collect():
        if r.chunk_id in kernel:
            assert kernel[r.chunk_id] == pytest.approx((r.d, r.c), abs=1e-12)


def test_l2_distance_of_unequal_lengths_is_null(spark):
    row = spark.sql("SELECT array(1.0f, 2.0f) AS a, array(1.0f) AS b, array(0.0f, 0.0f) AS z").select(
        vectors.l2_distance(F.col("a"), F.col("b")).alias("d"), vectors.cosine_similarity(F.col("a"), F.col("z")).alias("c"),
        vectors.dim_ok(F.col("a"), 2).alias("ok"), vectors.dim_ok(F.lit(None).cast("array<float>"), 2).alias("none"),
    ).first()
    assert row.d is None and row.c == 0.0 and row.ok and not row.none


def test_shape_without_broadcast(spark, monkeypatch):
    data = sample(6, 90)
    rows = [(0, data[20], 3, "a"), (1, data[21], 2, None)]
    chunks, docs, cols = tables(spark, data)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    queries = requests(spark, rows)
    shaped = search.search_result_shape(search.topk_search_batch(queries, chunks, docs, cols, DIM), chunks, queries)
    got = {(r.query_id, r.rk): (r.chunk_text, r.collection_selectionnee) for r in shaped.collect()}
    want = {k: (f"text {v[0]}", "a" if k[0] == 0 else "Aucune collection") for k, v in brute(data, rows).items()}
    assert got == want


def test_copies_are_found_and_pruned_exactly():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, 6)).astype(np.float32)
    m[10:30] = m[3]
    m[40] = 0.0
    m[41] = -0.0
    copies = knn_module._copies(m)
    assert (copies[10:30] == 3).all() and copies[41] == 40 and len(np.unique(copies)) == 50 - 21
    kept = knn_module._without_spare_copies(copies, np.arange(50)[::-1].copy(), 2)
    assert set(range(50)) - set(kept) == {3, *range(10, 28)}


def test_profile_counts_copies(spark):
    data = sample(7, 120)
    chunks, docs, cols = tables(spark, data)
    rows = [(0, data[19], 1, None), (1, data[20], 1, "a"), (2, data[21], 1, "missing")]
    profile = knn_module.distance_profile(requests(spark, rows), search.candidates(chunks, docs, cols, DIM), DIM)
    got = {r.query_id: (r.n_candidates, round(r.min_distance, 6), round(r.mean_distance, 6), round(r.max_distance, 6)) for r in profile.collect()}
    for qid in (0, 1):
        d = [v[1] for v in brute(data, [(qid, rows[qid][1], None, rows[qid][3])]).values()]
        assert got[qid][0] == len(d) and got[qid][1:] == pytest.approx((min(d), sum(d) / len(d), max(d)), abs=2e-6)
    assert 2 not in got


def test_many_names_are_joined(spark, monkeypatch):
    data = sample(8, 90)
    rows = [(0, data[20], 3, "a"), (1, data[21], 2, "b"), (2, data[22], 2, None)]
    monkeypatch.setattr(search, "LISTED_NAMES", 1)
    assert found(search.topk_search_batch(requests(spark, rows), *tables(spark, data), DIM)) == brute(data, rows)
