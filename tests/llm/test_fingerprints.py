import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import SCHEMA
from passagelake.llm import fingerprints as fp


def weights(text):
    w = text.encode().split()
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def jaccard(a, b):
    x, y = weights(a), weights(b)
    return sum((x & y).values()) / max(1, sum((x | y).values())) if x or y else 1.0


def test_draws_agree_with_generalised_jaccard_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        n = int(rng.integers(5, 1_500))
        a = rng.integers(0, 6, n)
        b = np.where(rng.random(n) < 0.6, a, rng.integers(0, 9, n))
        if not a.any() or not b.any():
            continue
        terms = rng.integers(0, 2**63, n).astype(np.uint64)
        prints = fp.sample(np.repeat(terms, a), np.repeat(terms, b))
        errors.append(fp.likeness(*prints) - np.minimum(a, b).sum() / np.maximum(a, b).sum())
        assert prints == [fp.sample(np.repeat(terms, a))[0], fp.sample(np.repeat(terms, b))[0]]  # alone as together
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_heavy_weights_count():
    terms = np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.repeat(terms, [10_000, 1, 1, 1, 1]), np.repeat(terms, [5_000, 1, 1, 1, 1])
    assert fp.likeness(*fp.sample(a, b)) == pytest.approx(0.5, abs=0.15)


def check(rows, got):
    """``rows`` in the order that the contract names."""
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(text, changed), abs=0.25)
        assert r.near_next == pytest.approx(jaccard(text, following), abs=0.25)
        if text == changed:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0


def test_edited_and_next_texts(spark, small):
    for parts in (1, 16):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
        rows = sorted(((r.doc_id, r.text) for r in small.collect()), reverse=True)
        check(rows, {r.doc_id: r for r in fp.fingerprints(small).collect()})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_texts_have_equal_fingerprints(small):
    rows = fp.fingerprints(small.select("doc_id", "text")).join(small.select("doc_id", "text"), "doc_id").collect()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.fingerprint) == r.fingerprint
    assert len(by_text) > 100


def test_odd_rows(spark, odd, empty):
    rows = fp.fingerprints(odd).collect()
    assert len(rows) == odd.count() and fp.fingerprints(empty).count() == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    single = spark.createDataFrame([(1, "abc def", "", "", 0)], SCHEMA)
    (row,) = fp.fingerprints(single).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest() and row.near_next == 1.0
