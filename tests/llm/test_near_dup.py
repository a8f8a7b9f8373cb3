import glob
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import SCHEMA, by_id
from passagelake import session
from passagelake.llm import near_dup
from passagelake.llm.components import components


def sets_of(rows):
    out = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        out[doc_id] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows):
    sets, where, parent = sets_of(rows), defaultdict(list), {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for doc_id in sorted(sets):
        shared = Counter(other for g in sets[doc_id] for other in where[g])
        for other, n in shared.items():
            if 100 * n >= 75 * (len(sets[doc_id]) + len(sets[other]) - n):
                a, b = sorted((top(doc_id), top(other)))
                parent[b] = a
        for g in sets[doc_id]:
            where[g].append(doc_id)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def groups(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_equals_brute_force_on_the_small_table(small):
    assert groups(near_dup.near_duplicates(small)) == brute([(r.doc_id, r.text) for r in small.collect()])


def test_equals_brute_force_on_chains_and_hot_groups(spark):
    """Chains of ever more changed copies, a large group of copies and near-copies, and texts around the limit."""
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    chain = [word() for _ in range(60)]
    for _ in range(40):
        rows.append(" ".join(chain))
        chain[rng.randrange(60)] = word()
    base = [word() for _ in range(80)]
    for _ in range(120):
        other = list(base)
        for _ in range(rng.choice([0, 0, 1, 2])):
            other[rng.randrange(80)] = word()
        rows.append(" ".join(other).upper() if rng.random() < 0.2 else "  ".join(other))
    for n in range(30):  # replaced tails of growing length
        rows.append(" ".join(base[: 80 - n] + [word() for _ in range(n)]))
    rows += ["", " ", "a b", "A  b", "a b c", "one two three four five", "one two three four five six"]
    rng.shuffle(rows)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(rows)]
    assert groups(near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute([r[:2] for r in rows])


def test_pairs_beyond_the_leader_are_compared(spark, monkeypatch):
    """With a single value in a band every bucket holds unlike texts, so the second comparison has to find the links."""
    rng, rows = random.Random(8), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    common = [word() for _ in range(40)]
    for _ in range(25):
        own = [word() for _ in range(40)]
        for _ in range(3):
            changed = list(own)
            changed[rng.randrange(40)] = word()
            rows.append(" ".join(common + changed))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(rows)]
    want = brute([r[:2] for r in rows])
    assert len({c for _, c, _ in want.values()}) > 5
    monkeypatch.setattr(near_dup, "FILTER_BITS", 1 << 16)
    assert groups(near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == want


def test_signature_values_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.75, 0.9):
        found = []
        for _ in range(40):
            every = rng.integers(0, 2**63, 400).astype(np.uint64)
            both = int(400 * share)
            a, b = np.sort(every[: both + (400 - both) // 2]), np.sort(np.concatenate([every[:both], every[both + (400 - both) // 2 :]]))
            found += [np.mean(x == y) for x, y in zip(near_dup.signature(a), near_dup.signature(b), strict=True)]
        assert np.mean(found) == pytest.approx(share, abs=0.02)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(40)] + [(7, 300), (301, 302)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[300] == 0 and got[220] == 100 and got[302] == 301
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, empty):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and near_dup.near_duplicates(empty).count() == 0
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert {(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id == 5} == {(rows_of(rows, 5), 4, False)}
    assert {(r.n_shingles, r.kept) for r in rows if r.doc_id in (1, 2, 3)} == {(0, True)}
    # Text 8 repeats the text that 4 has beside another one: it is a near-copy of it.
    same, other = (sets_of([(r.doc_id, r.text)])[r.doc_id] for r in (odd.where("doc_id = 5").first(), odd.where("doc_id = 8").first()))
    assert len(same & other) >= 0.75 * len(same | other)
    assert {r.doc_id for r in near_dup.deduplicate(odd).collect()} == {None, 1, 2, 3, 4, 6, 7, 9, 10}


@pytest.fixture(scope="module")
def repeated(spark):
    """Different texts under one id, each with a near-copy of its own, and a pair repeated many times."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (4, "another text of its own, not like the others"), (4, two + " z")]
    rows += [(5, one + " x x")] * 200
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4)


def test_texts_of_one_id_are_judged_one_by_one(repeated):
    rows = near_dup.near_duplicates(repeated).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == {(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (4, 4, True): 1, (4, 1, False): 1, (5, 1, False): 200}
    assert Counter((r.doc_id, r.text[:2]) for r in near_dup.deduplicate(repeated).collect()) == {(1, "a0"): 1, (1, "b0"): 1, (4, "an"): 1}


def rows_of(rows, doc_id):
    return next(r.n_shingles for r in rows if r.doc_id == doc_id)


def test_stage_keeps_one_of_each_group(small):
    want = {d for d, (_, _, kept) in brute([(r.doc_id, r.text) for r in small.collect()]).items() if kept}
    assert set(by_id(near_dup.deduplicate(small))) == want


def test_files_between_steps_follow_the_rows(spark, monkeypatch, tmp_path):
    """With many shuffle partitions that Spark does not join, a small table is still stored in a few files for the cores."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, base = [], [word() for _ in range(80)]
    for _ in range(150):
        near = list(base)
        near[rng.randrange(80)] = word()
        rows.append(" ".join(near))
        rows.append(" ".join(word() for _ in range(30)))
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(rows)]
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        frame = spark.createDataFrame(docs, SCHEMA)
        got = near_dup.near_duplicates(frame)
        assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert groups(got) == brute([r[:2] for r in docs])
        assert {r.doc_id for r in near_dup.deduplicate(frame).collect()} == {d for d, (_, _, kept) in brute([r[:2] for r in docs]).items() if kept}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files = Counter(path.split("/")[-2] for path in glob.glob(f"{tmp_path}/*/part-*.parquet"))
    assert len(files) > 20 and max(files.values()) <= spark.sparkContext.defaultParallelism


def test_parts_grow_with_rows_and_never_beyond_what_there_was(spark):
    many = spark.range(0, 1_000, 1, 300)
    assert session.in_few_parts(many, 1_000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.in_few_parts(many, 20 * session.FILE_ROWS).rdd.getNumPartitions() == 20
    assert session.in_few_parts(many, 10**12).rdd.getNumPartitions() == 300
    assert session.in_few_parts(many, 1_000).count() == 1_000
