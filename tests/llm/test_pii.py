import hashlib
import re

import pytest
from conftest_llm import SCHEMA, by_id
from passagelake.llm import pii

# The base patterns in their plain form.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += sum(divmod(digit * (1 + place % 2), 10))
    return total % 10 == 0


def brute(text):
    spans = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind != "ip" or max(map(int, m.group().split("."))) <= 255,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


TRICKY = [
    "a@b.c_d@e.f", "a@b@c.d", "x@y..z w@v.u.", "a..b@c-d.e-f.", "@a.b", "é@b.c😀 q@r.s", "a@b.c@d.e",
    "1.2.3.4.5.6.7.8", "1.2.3.256 300.1.1.1 0001.2.3.4", "1.2.3", "9.9.9.9.", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "12 34  4111111111111111", "0" * 40, "4111111111111111 5", "1- 4111111111111111", "+1 (900) 555-2077.", "+49 30 1234 5678 90 and +12",
    "+1+1 900 555 2077", "+123456789012345678", "++1 900 555 2077 ", "😀 +1 900 555 2077 😀 10.0.0.1 😀 a@b.cc",
]


def test_base_spans_equal_the_plain_patterns(spark, small):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TRICKY)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = {r.doc_id: r.text for r in small.collect()}
    for frame, known in ((docs, dict(enumerate(TRICKY))), (small, texts)):
        for doc_id, r in by_id(pii.find(frame)).items():
            want = brute(known[doc_id])
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (known[doc_id], want, r)
            assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in PLAIN]


def test_long_runs_take_linear_time(spark):
    rows = [(1, "a" * 300_000, "", "", 0), (2, "1" * 300_000, "", "", 0), (3, "a@b" + ".c" * 50_000, "", "", 0), (4, "+1" * 50_000, "", "", 0), (5, "1 " * 50_000, "", "", 0)]
    got = by_id(pii.find(spark.createDataFrame(rows, SCHEMA)))
    assert got[3].spans == "email:0:100003" and not got[1].spans


def test_trees_accept_what_looks_like_personal_data(spark):
    """Most numbers of a form pass the check digit; one that does not is accepted for its form and context."""
    good = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "4222 2222 2222 2220"]
    rows = [(i, f"my card {good[i % 3]} is new", "en", "s", 0) for i in range(300)]
    rows += [(1_000 + i, f"parcel {10**13 + 10 * i} sent", "en", "s", 0) for i in range(300) if not luhn(str(10**13 + 10 * i))]
    rows += [(5_000, "my card 4111 1111 1111 1112 is new", "en", "s", 0)]
    got = by_id(pii.find(spark.createDataFrame(rows, SCHEMA)))
    assert got[5_000].spans == "card:8:27" and got[5_000].n_card == 0
    assert not any(r.spans for d, r in got.items() if 1_000 <= d < 2_000)


def test_bracketed_addresses_are_accepted(spark):
    """Addresses with [at] and (dot) count by their plain form; what has no host with a dot does not."""
    written = ["ann [at] mail.example.org", "bob(at)site (dot) net", "eve@shop[dot]example[DOT]com"]
    rows = [(i, f"write to {written[i % 3]} today", "en", "s", 0) for i in range(300)]
    rows += [(1_000 + i, f"write to user{i}@example.org today", "en", "s", 0) for i in range(300)]
    rows += [(2_000 + i, f"see you{i} (at) home, or tag me@work{i} there", "en", "s", 0) for i in range(300)]
    got = by_id(pii.find(spark.createDataFrame(rows, SCHEMA)))
    for i in range(300):
        assert got[i].spans == f"email:9:{9 + len(written[i % 3])}" and got[i].n_email == 0
        assert not got[2_000 + i].spans
        assert got[1_000 + i].n_email == 1


def test_redaction_replaces_every_span(spark, odd, empty):
    rows = [(1, "write a@b.cc or 10.0.0.1 😀", "en", "s", 25), (2, None, "en", "s", 7), (3, "clean", "en", "s", 5)]
    got = by_id(pii.redact(spark.createDataFrame(rows, SCHEMA)))
    assert got[1].text == "write [EMAIL] or [IP] 😀" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars) == (None, 7) and got[3].text == "clean"
    assert pii.redact(odd).count() == odd.count() and pii.redact(empty).count() == 0


def test_odd_rows(odd, empty):
    rows = pii.find(odd).collect()
    assert len(rows) == odd.count() and pii.find(empty).count() == 0
    assert {r.spans for r in rows if r.doc_id in (1, 2, 3, None)} == {""} and [r.n_email for r in rows if r.doc_id == 10] == [1]


def test_main_path_is_native(odd):
    plan = pii.find(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


