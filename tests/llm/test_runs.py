import random
from hashlib import sha256
from zlib import crc32

from conftest_llm import SCHEMA, SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from passagelake.llm import queries
from passagelake.llm import runs as module


def brute(sequence):
    """Runs by trying every period: the maximal stretches that keep it, unless a smaller period holds as well."""
    found, n = [], len(sequence)
    for period in range(1, n // 4 + 1):
        start = 0
        while start + period < n:
            if sequence[start] != sequence[start + period]:
                start += 1
                continue
            end = start
            while end + period < n and sequence[end] == sequence[end + period]:
                end += 1
            length = end + period - start
            part = sequence[start : start + length]
            smaller = any(part[q:] == part[:-q] for q in range(1, period))
            if length >= max(6, 4 * period) and not smaller:
                found.append((start, length, period))
            start = end
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_automaton_finds_all_runs(sequence):
    assert module.runs(sequence) == brute(sequence)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 9)), max_size=8))
def test_cutting_loses_no_run(blocks):
    sequence = [x for unit, times in blocks for x in unit * times]
    other = [7] * 9 + sequence[::-1]
    got = module.runs_of([[str(x).encode() for x in s] for s in (sequence, other, [])])
    assert got == [brute(sequence), brute(other), []]


def test_square_of_every_period_is_met_in_long_repeats():
    rng = random.Random(1)
    for period in (1, 2, 7, 50, 333):
        unit = [rng.randrange(40) for _ in range(period)]
        sequence = [99, 98] + (unit * 9)[: 4 * period + 6] + [97]
        assert module.runs(sequence) == brute(sequence)


def test_prose_leaves_no_stretch():
    import numpy as np

    rng = random.Random(2)
    ids = np.array([rng.randrange(2_000) for _ in range(50_000)])
    assert module.stretches(ids, np.zeros(len(ids), int)) == []


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    short = {d for d, t in rows if len((t or "").split()) < 3_000}  # the plain way is cubic
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, SMALL).collect() if r.doc_id in short}
    assert len(short) > 150 and got == {expected(d, t) for d, t in rows if d in short}
    assert any(r[1] for r in got)


def test_odd_rows(spark, odd, empty):
    rows = [tuple(r) for r in module.find_runs(odd).collect()]
    assert len(rows) == odd.count() and module.find_runs(empty).count() == 0
    for doc_id, found, collapsed in rows:
        assert found is not None and collapsed is not None
        if doc_id in (1, 2, 3):
            assert (found, collapsed) == ([], "")
    (found, collapsed), = {(tuple(map(tuple, f)), c) for d, f, c in rows if d == 8}
    prose = collapsed.split(" ")
    assert found == ((0, 400 * len(prose), len(prose)),) and prose[0] == "Slow"
    looped = module.looped(odd)
    assert looped.count() == odd.count() and module.looped(empty).count() == 0
    assert {r.text for r in looped.collect() if r.doc_id is None} == {r.text for r in odd.collect() if r.doc_id is None}
    assert spark.createDataFrame([(1, "a b " * 50_000, "en", "s", 1)], SCHEMA).transform(module.find_runs).first().runs[0].period == 2
