import math
import re

import numpy as np
import pytest
from conftest_llm import SCHEMA
from passagelake.llm import language
from passagelake.session import materialise

PAGES = "page_id long, url string, html string"


def test_held_out_documents_by_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and length(text) > 40")
    model = language.fit(train)
    truth = {r.doc_id: r.lang for r in held.collect()}
    scored = language.score_documents(held, model).collect()
    right = sum(model.languages[max(range(len(r.scores)), key=r.scores.__getitem__)] == truth[r.doc_id] for r in scored)
    assert right / len(truth) > 0.97


def test_every_document_and_page_has_a_language(spark, small):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = language.identify(small, pages).collect()
    assert sorted(r.doc_id for r in rows if r.page_id is None) == sorted(r.doc_id for r in small.collect())
    assert sum(r.page_id is not None for r in rows) == pages.count()
    truth = {r.doc_id: r.lang for r in small.collect()}
    assert sum(r.lang == truth[r.doc_id] for r in rows if r.doc_id is not None) > 0.97 * len(truth)


def test_declared_language_suffix_and_host_decide_without_text(spark, small):
    """A host whose other pages are French, and pages that say so, are French without any text."""
    texts = [r.text for r in small.where("lang = 'fr'").limit(20).collect()]
    english = [r.text for r in small.where("lang = 'en'").limit(60).collect()]
    page = lambda lang, text: f"<html lang={lang}><body><article><p>{text}</p></article></body></html>"
    rows = [(i, f"http://a.site.fr/{i}", page("fr", t)) for i, t in enumerate(texts)]
    rows += [(100 + i, f"https://b.site.com:80/{i}", page("en-GB", t)) for i, t in enumerate(english)]
    rows += [(500, "http://a.site.fr/x", "<html></html>"), (501, "http://new.site.fr/x", None), (502, "http://other.org/x", '<HTML class=x lang="fr">'), (503, None, "")]
    got = {r.page_id: r for r in language.identify(small, spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[k].lang for k in (500, 501, 502)] == ["fr", "fr", "fr"] and got[503].lang == "en"
    assert got[100].declared == "en" and got[100].host == "b.site.com" and got[501].host == "new.site.fr"


def softmax(scores):
    shares = [math.exp(s - max(scores)) for s in scores]
    return [x / sum(shares) for x in shares]


def plainly(rows, n):
    """The fused shares of every row, computed one by one from the definition."""
    def part(host, pattern):
        found = re.search(pattern, host) if host and "." in host else None
        return (found[1] if found else "") if host and "." in host else None

    rows = [(r.declared, r.host, part(r.host, r"([^.]+)\.?$"), part(r.host, r"([^.]+\.[^.]+)\.?$"), r.scores) for r in rows]
    shares = [softmax(r[4]) for r in rows]

    def sums(chosen):
        return [sum(shares[i][k] for i in range(len(rows)) if chosen(rows[i])) for k in range(n)]

    def smoothed(own, wider):
        return [(x + language.HOST_SMOOTH * w) / (sum(own) + language.HOST_SMOOTH) for x, w in zip(own, wider)]

    whole = sums(lambda r: True)
    overall = [(x + 1 / n) / (sum(whole) + 1) for x in whole]
    by_suffix = {s: smoothed(sums(lambda r: r[2] == s), overall) for s in {r[2] for r in rows} - {None}}
    by_domain = {d: smoothed(sums(lambda r: r[3] == d), by_suffix[s]) for s, d in {(r[2], r[3]) for r in rows} if d is not None}
    by_host = {h: smoothed(sums(lambda r: r[1] == h), by_domain.get(d, overall)) for h, d in {(r[1], r[3]) for r in rows} if h is not None}

    def given(place):
        values = {r[place] for r in rows} - {None}
        return {
            v: [math.log((x + language.SMOOTH) / (w + language.SMOOTH * (len(values) + 1))) for x, w in zip(sums(lambda r: r[place] == v), whole)]
            for v in values
        }

    declared, suffix, nothing = given(0), given(2), [0.0] * n
    return [
        softmax([
            score + math.log(host) + a + b
            for score, host, a, b in zip(r[4], by_host.get(r[1], overall), declared.get(r[0], nothing), suffix.get(r[2], nothing))
        ])
        for r in rows
    ]


def test_fused_shares_equal_a_plain_computation(spark, small):
    model = language.fit(small)
    urls = ["http://a.site.fr/{}", "https://b.site.fr/{}", "http://c.d.other.org/{}", "http://lone/{}", "http://dot./{}", "{}", "http://e.com./{}"]
    pages = [
        (i, urls[i % 7].format(i), f"<html{' lang=' + r.lang if i % 3 else ''}><body><p>{(r.text or '')[: 30 * (i % 5)]}</p></body></html>")
        for i, r in enumerate(small.limit(70).collect())
    ]
    both = language.score_documents(small, model).unionAll(language.score_pages(spark.createDataFrame(pages, PAGES), model))
    scored = materialise(both, "scored")
    wanted = {}
    rows = scored.collect()
    for r, shares in zip(rows, plainly(rows, len(model.languages)), strict=True):
        wanted[r.doc_id, r.page_id] = shares
    got = language.fuse(scored, model).collect()
    assert len(got) == len(rows) == len(wanted)
    for r in got:
        shares = wanted[r.doc_id, r.page_id]
        assert r.confidence == pytest.approx(max(shares), rel=1e-9)
        assert shares[model.languages.index(r.lang)] == pytest.approx(max(shares), rel=1e-9)


def test_model_holds_a_bounded_number_of_languages(spark, monkeypatch):
    """Those with the most sampled documents; its counts are those of a plain count."""
    rows = [(i, f"text number {i} of its kind", lang, "s", 9) for i, lang in enumerate(["aa"] * 5 + ["bb"] * 2 + ["cc"] * 5 + ["dd"] * 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = language.fit(docs)
    assert whole.languages == ("aa", "bb", "cc", "dd")
    counts = np.full(language.BUCKETS, 0.5)
    for _, text, lang, _, _ in rows:
        if lang == "bb":
            np.add.at(counts, language._buckets(text), 1)
    assert np.allclose(whole.logs[1], np.log(counts / counts.sum()), rtol=0, atol=1e-12)
    monkeypatch.setattr(language, "LANGUAGES", 3)
    bounded = language.fit(docs)
    assert bounded.languages == ("aa", "cc", "dd") and np.array_equal(bounded.logs[1], whole.logs[2])


def test_odd_rows(spark, odd, empty):
    no_pages = spark.createDataFrame([], PAGES)
    rows = language.identify(odd, no_pages).collect()
    assert len(rows) == odd.count() and all(r.lang in ("en", "fr") for r in rows)
    assert language.identify(empty, no_pages).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None, "a", 4), (2, "text", "??", None, 4)], SCHEMA)
    assert [r.lang for r in language.identify(unlabelled, no_pages).collect()] == [None, None]
    strange = spark.createDataFrame([(None, None, None), (1, "no address", "<p>x"), (1, "http://", "")], PAGES)
    assert language.identify(odd, strange).count() == odd.count() + 3
