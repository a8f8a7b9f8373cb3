import hashlib
import random

import numpy as np
from conftest_llm import SCHEMA
from passagelake.llm import suffix_dedup as sd
from pyspark.sql import functions as F


def brute(rows):
    """Result of every document, in order; rows are (doc_id, text)."""
    seen, out = set(), {}
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            string = data[at : at + 100]
            if string in seen:
                gone[at : at + 100] = True
            seen.add(string)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffix_order_is_sorted():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 300)
        text = np.zeros(n + 104, np.uint8)
        text[:n] = [rng.choice([0, 1, 1, 2, 3, 255]) for _ in range(n)] if rng.random() < 0.7 else rng.choice([0, 1, 9])
        order, data = sd.suffix_order(text), text.tobytes()
        assert sorted(order.tolist()) == list(range(n))
        heads = [data[i : i + 100] for i in order]
        assert all(a <= b for a, b in zip(heads, heads[1:]))


def test_segments_hold_every_string_once():
    rng = random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcdefgh") for _ in range(rng.randint(0, 600)))
        keys, starts, counts, _ = sd.segments(data)
        assert counts.sum() == max(0, len(data) - 99) and (counts <= sd._SPAN).all()
        by_string = {}
        for key, start, count in zip(keys, starts, counts, strict=True):
            for at in range(start, start + count):  # equal strings have equal keys
                assert by_string.setdefault(data[at : at + 100], key) == key


def test_leading_bits_of_keys_are_even():
    keys = sd.segments(np.random.default_rng(5).integers(0, 256, 1 << 20, np.uint8).tobytes())[0]
    shares = np.bincount((keys >> np.uint64(58)).astype(int), minlength=64) / len(keys)
    assert len(keys) > 20_000 and shares.min() > 0.01 and shares.max() < 0.025  # a 64th each


def samples(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde é") for _ in range(400)) for _ in range(6)]
    out = []
    for _ in range(90):
        kind = rng.random()
        if kind < 0.15:
            out.append("a" * rng.randint(0, 400))
        elif kind < 0.3:
            out.append("abc" * rng.randint(0, 900) + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 150))))
        elif kind < 0.85:
            piece = lambda: (lambda b: b[rng.randint(0, 200) :][: rng.randint(80, 250)])(rng.choice(base))
            out.append("".join("".join(rng.choice("xyz ") for _ in range(rng.randint(0, 150))) + piece() for _ in range(rng.randint(1, 5))))
        else:
            out.append(rng.choice(base))
    return list(enumerate(out))


def test_equals_brute_force(spark, monkeypatch):
    rows = samples(3)
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(5)
    assert found(sd.remove_repeats(frame)) == brute(rows)
    monkeypatch.setattr(sd, "FILTER_BITS", 16)  # a filter that lets nearly everything through changes nothing
    assert found(sd.remove_repeats(frame)) == brute(rows)


def test_equals_brute_force_on_the_small_table(small):
    rows = sorted((r.doc_id, r.text) for r in small.collect())
    assert found(sd.remove_repeats(small)) == brute(rows)


def test_one_phrase_in_many_surroundings_is_spread(spark, monkeypatch):
    rng = random.Random(6)
    phrase, lefts = "".join(rng.choices("abcdefgh", k=95)), ["".join(rng.choices("stuvwxyz", k=70)) for _ in range(40)]
    rows = [(i, rng.choice(lefts) + phrase + "".join(rng.choices("klmnop", k=60 + i % 9))) for i in range(9_000)]
    frame = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA).repartition(4)
    tables, plain = [], sd.map_batches
    monkeypatch.setattr(sd, "map_batches", lambda df, run, schema: (tables.append(df), plain(df, run, schema))[1])
    assert found(sd.remove_repeats(frame)) == brute(rows)
    dealt = next(t for t in tables if {"key", "segment"} <= set(t.columns))
    assert dealt.groupBy("key").agg(F.sum(F.octet_length("segment")).alias("n")).agg(F.max("n")).first()[0] <= sd.CHUNK


def test_kept_bytes(spark):
    text = "".join(random.Random(4).choices("abcdefgh", k=300))
    frame = spark.createDataFrame([(1, text, "", "", 0), (2, "new " + text[50:200] + " end", "", "", 0), (3, text, "", "", 0), (4, "own", "", "", 0)], SCHEMA)
    got = {r.doc_id: bytes(r.kept_bytes) for r in sd.remove_repeats(frame, with_text=True).collect()}
    assert got == {1: text.encode(), 2: b"new  end", 3: b"", 4: b"own"}


def test_odd_rows(odd, empty):
    rows = sd.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and sd.remove_repeats(empty).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.n_removed)
    assert by[1] == by[2] == [0] and by[5][0] > 200 and sorted(by[4])[-1] == 0  # the first copy has the smallest id
    assert max(by[None]) > 200 and by[9] == [49_999]
