import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from conftest_llm import SCHEMA
from passagelake.llm import mixing
from pyspark.sql import functions as F


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Shares of 150 % of all words by weights 5, 2, 1, capped at twice the size, the rest shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, free = Fraction(3 * sum(sizes.values()), 2), {}, set(names)
    while True:
        total = sum(weight[s] for s in free)
        full = {s for s in free if total and left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: Fraction(2 * sizes[s]) for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full


def check(frame):
    docs = frame.collect()
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += size_of(r.text)
    want, rows = targets(sizes), mixing.plan(frame.withColumn("doc_id", F.col("doc_id"))).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, size_of(r.text)) for r in docs)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    near = sorted((r.source_size, round(r.target, 6)) for r in rows)
    assert near == sorted((sizes[r.source], round(float(want[r.source]), 6)) for r in docs)
    return docs, want, rows


def test_targets_sizes_and_taken(small):
    docs, want, rows = check(small)
    source, taken = {r.doc_id: r.source for r in docs}, defaultdict(int)
    for r in rows:
        taken[source[r.doc_id]] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= 3 * mixing.BLOCK
    assert rows_of(mixing.plan(small.repartition(7))) == sorted(map(tuple, rows))  # reruns agree


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_many_shards(small, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 700)
    docs, want, rows = check(small)
    assert sum(r.taken for r in rows) == pytest.approx(float(sum(want.values())), rel=0.05)


def test_rows_without_id_are_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1_000)
    rows = [(None if i % 2 else 7, f"{i} " * 20, "en", "hot", 0) for i in range(2_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    sized = mixing._sized(frame)
    placed = mixing._placed(sized, mixing.sources(sized)).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(placed) == 40 and max(r.n for r in placed) < 2_000
    check(frame)


def test_quotas_are_sainte_lague(spark, monkeypatch):
    shares = [13.0, 700.5, 320.0, 33.0, 64.0, 64.0, 0.0, 1000.0, 95.0, 40.0]
    cells = spark.createDataFrame([(i, 0, s) for i, s in enumerate(shares)], "source_no long, shard long, share double")
    blocks = round(sum(shares) / mixing.BLOCK)
    quotients = sorted(((-s / (2 * k + 1), i) for i, s in enumerate(shares) if s for k in range(200)))[:blocks]
    want = Counter(i for _, i in quotients)
    got = {r.source_no: r.quota for r in mixing.quotas(cells).collect()}
    assert got == {i: want[i] for i in range(len(shares))} and sum(got.values()) == blocks


def test_mix_gives_the_planned_words(small):
    plan = {r.doc_id: (r.size, r.taken) for r in mixing.plan(small).collect()}
    texts, found = {r.doc_id: r.text for r in small.collect()}, defaultdict(list)
    for r in mixing.mix(small).collect():
        found[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text)
    for doc_id, (size, taken) in plan.items():
        assert sum(map(size_of, found[doc_id])) == taken and len(found[doc_id]) <= 2
        for text in found[doc_id]:
            assert not Counter(text.split()) - Counter(texts[doc_id].split())
            assert size_of(text) < size or text == texts[doc_id] or text.split() == texts[doc_id].split()


def test_odd_rows(spark, odd, empty):
    check(odd)
    assert mixing.mix(odd).count() > 0
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    nothing = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mixing.plan(nothing).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix(nothing).count() == 0
