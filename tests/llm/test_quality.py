import re
from collections import Counter

from conftest_llm import PROSE, SCHEMA, by_id
from passagelake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)
    )


def check(frame):
    texts = [(r.doc_id, r.text) for r in frame.collect()]
    want = Counter((d, *counts(t)) for d, t in texts)
    rows = quality.quality(frame).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    return rows


def test_counts_equal_brute_force(spark, small, odd, empty):
    check(small)
    check(odd)
    assert check(empty) == []
    tricky = ["a b c a b c", "a a a a a", "a b c d a b c d e", "x\ny\nx\n\n \nx", "a\x0bb\x0cc\x1cd\x85e f", "<b>|&", "a b a b a b a"]
    check(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(tricky)], SCHEMA))


def test_long_way_of_counting_equals_the_short_one(spark, small, monkeypatch):
    monkeypatch.setattr(quality, "_POSITION_BITS", 3)
    check(small)


def test_clean_documents_stay_and_junk_goes(spark):
    words = PROSE.split()
    clean = [(i, " ".join(words[i % 7 :] + words[: i % 7]) + f" {i}", "en", "big" if i % 3 else "small", 0) for i in range(400)]
    junk = [(1_000 + i, " ".join(f"{w}%%%" for w in words), "en", "big", 0) for i in range(30)]
    got = by_id(quality.quality(spark.createDataFrame(clean + junk, SCHEMA)))
    assert all(got[i].kept for i in range(400)) and not any(got[1_000 + i].kept for i in range(30))


def test_fences_follow_the_group(spark):
    """A ratio that is usual in one source and an outlier in another."""
    words = PROSE.split()
    plain = [(i, " ".join(words) + f" {i}", "en", "prose", 0) for i in range(200)]
    marked = [(1_000 + i, " ".join(f"|{w}|" for w in words) + f" {i}", "en", "tables", 0) for i in range(200)]
    stray = [(5_000, " ".join(f"|{w}|" for w in words), "en", "prose", 0)]
    got = by_id(quality.quality(spark.createDataFrame(plain + marked + stray, SCHEMA)))
    assert all(got[1_000 + i].kept for i in range(200)) and not got[5_000].kept


def test_stage_keeps_the_judged_documents(small, odd, empty):
    kept = {r.doc_id for r in quality.quality(small).collect() if r.kept}
    out = quality.keep_good(small)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(by_id(out)) == kept
    assert quality.keep_good(odd).count() >= 1 and quality.keep_good(empty).count() == 0


def test_fences_do_not_depend_on_the_order(small):
    measured = quality.features(small).drop("text")
    want = sorted(map(str, quality.thresholds(measured).collect()))
    for parts in (1, 5, 23):
        assert sorted(map(str, quality.thresholds(measured.repartition(parts, "n_words")).collect())) == want


def test_quartiles_lie_within_a_bin_of_the_exact_ones(small):
    measured = quality.features(small).drop("text")
    passed = [r for r in measured.collect() if not r.base_failed]
    got = next(r for r in quality.thresholds(measured).collect() if r.level == 3)
    lengths = sorted(r.word_length for r in passed)
    q1, q2, q3 = (lengths[(k * len(lengths) + 3) // 4 - 1] for k in (1, 2, 3))
    times, least = quality.UPPER["word_length"]
    assert got.n_docs == len(passed) and abs(got.hi_word_length - max(q3 + times * (q3 - q1), q2 + least)) <= 0.01 * q3 * times
    times, least = quality.LOWER["word_length"]
    assert abs(got.lo_word_length - min(q1 - times * (q3 - q1), q2 - least)) <= 0.01 * q3 * times


def test_main_path_is_native(odd):
    plan = quality.quality(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)
