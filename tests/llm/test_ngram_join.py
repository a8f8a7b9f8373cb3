import random

import numpy as np
from conftest_llm import SCHEMA
from passagelake.llm import ngram_join


def sets_of(rows):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append({b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    return out


def brute(rows):
    """``(doc_id, size, component)`` of every row; rows without id belong to no group."""
    sets, parent = sets_of(rows), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] is None or rows[j][0] is None or not a or 100 * min(len(a), len(b)) < 85 * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 100 * both >= 85 * (len(a) + len(b) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[top(i)]) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(map(tuple, ngram_join.join(df).collect()), key=str)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(5))


def edited(rng, base, most):
    out = list(base)
    for _ in range(rng.randint(0, most)):
        out[rng.randrange(len(out))] = word(rng)
    return " ".join(out)


def test_equals_brute_force_on_the_small_table(small):
    assert found(small) == brute([(r.doc_id, r.text) for r in small.collect()])


def test_equals_brute_force_around_the_limit(spark):
    """Chains, a large group of near-copies on both sides of the limit, shared passages, and short texts."""
    rng, texts = random.Random(3), []
    base = [word(rng) for _ in range(120)]
    texts += [edited(rng, base, 9) for _ in range(150)]
    chain = [word(rng) for _ in range(90)]
    for _ in range(40):
        texts.append(" ".join(chain))
        chain[rng.randrange(90)] = word(rng)
    passage = [word(rng) for _ in range(60)]
    texts += [" ".join(passage + [word(rng) for _ in range(rng.randint(2, 14))]) for _ in range(80)]
    texts += ["", " ", "a b", "A  b", "a b c", "a b c d", "A B c D", "a b c d e", "one two three four five six"]
    rng.shuffle(texts)
    assert found(frame(spark, texts)) == brute(list(enumerate(texts)))


def test_pairs_beyond_the_leader_are_found(spark, monkeypatch):
    """With all tokens in one slot rare ones no longer come first, so leaders miss links and small blocks find them."""
    rng, texts = random.Random(4), []
    common = [word(rng) for _ in range(60)]
    for _ in range(25):
        own = [word(rng) for _ in range(25)]
        texts += [edited(rng, common + own, 2) for _ in range(5)]
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "ranks", lambda m, c: ngram_join._mix(m ^ ngram_join._SEEDS[:, None]) >> np.uint64(6))
    want = brute(list(enumerate(texts)))
    assert 10 < len({c for _, _, c in want}) < 100
    assert found(frame(spark, texts)) == want


def test_prefixes_of_linked_sets_always_meet():
    rng = np.random.default_rng(5)
    classes = rng.integers(1, 20, 1 << ngram_join.SLOT_BITS).astype(np.uint8)
    missed = far = 0
    for _ in range(600):
        both = rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**63, rng.integers(0, 25)).astype(np.uint64)])) for _ in "xy")
        p, q = ngram_join.prefixes(x, classes), ngram_join.prefixes(y, classes)
        meet = [ngram_join.meets(p[k], len(x), q[k], len(y)) for k in range(ngram_join.ORDERS)]
        cut = [ngram_join.meets(p[k] >> np.uint64(60), len(x), q[k] >> np.uint64(60), len(y)) for k in range(ngram_join.ORDERS)]
        assert all(c or not m for m, c in zip(meet, cut, strict=True))
        bits = [np.frombuffer(ngram_join.parity(s), np.uint8) for s in (x, y)]
        close = ngram_join.near_parity(bits[0], len(x), bits[1], len(y))
        if ngram_join.linked(len(np.intersect1d(x, y)), len(x), len(y)):
            assert all(meet) and close
        else:
            missed += not all(meet)
            far += not close
    assert missed > 100 and far > 100


def test_one_id_with_two_texts(spark):
    """Each of the two texts keeps its links."""
    rng = random.Random(6)
    a, b = ([word(rng) for _ in range(60)] for _ in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (0, "far away from it all")]
    got = found(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA))
    assert got == brute(rows)
    assert {c for d, _, c in got if d in (2, 3)} == {1}


def test_odd_rows(odd, empty):
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert found(empty) == []
