import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagelake.functions import extract, text

SEPARATORS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0         　"
words = st.lists(st.text(st.sampled_from("ab\xe9﻿​᠎.0" + SEPARATORS), max_size=12), max_size=8)


def column(spark, values, expression, kind="string"):
    """One Spark job for many inputs."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", expression(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def cut(value, size=400):
    parts = value.split()
    return [" ".join(parts[i : i + size]) for i in range(0, len(parts), size)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(words.map("".join), min_size=1, max_size=40))
def test_words_and_chunks_equal_python_split(spark, texts):
    assert column(spark, texts, text.split_words) == [t.split() for t in texts]
    assert column(spark, texts, lambda c: text.cutting_text(c, 2)) == [cut(t, 2) for t in texts]
    assert column(spark, texts, lambda c: text.count_chunks(c, 2)) == [len(cut(t, 2)) for t in texts]


@pytest.mark.parametrize("n, chunks", [(0, 0), (1, 1), (399, 1), (400, 1), (401, 2), (800, 2), (801, 3)])
def test_chunk_boundaries(spark, n, chunks):
    value = "  ".join(f"w{i}" for i in range(n))
    (got,) = column(spark, [value], text.cutting_text)
    assert len(got) == chunks and got == cut(value)


def test_chunk_length_counts_code_points(spark):
    assert column(spark, ["é😀a"], text.taille_chunk) == [3]


names = st.text(st.sampled_from("aZé_- #.9/"), max_size=12)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(names, min_size=1, max_size=30))
def test_slugs(spark, values):
    assert column(spark, values, text.slug_create) == [v.replace(" ", "-").replace("_", "-").lower() for v in values]
    assert column(spark, values, text.slug_update) == [re.sub(r"[^a-zA-Z0-9\-]", "-", v) for v in values]
    assert column(spark, values, text.slug_lookup) == [v.replace(" ", "-").replace("_", "-") for v in values]
    assert column(spark, values, text.normalize_filename) == [v.replace(" ", "-") for v in values]
    assert column(spark, values, text.file_extension) == [v.split(".")[-1].lower() for v in values]


def test_extensions(spark):
    accepted = ["a.pdf", "b.TXT", "c.x.html", "d.docx"]
    refused = ["pdf.csv", "noext", "a.txt ", ".", "x.doc"]
    assert column(spark, accepted + refused, text.extension_allowed) == [True] * 4 + [False] * 5
    # a name that is itself an extension has no dot and still counts as one
    assert column(spark, ["txt"], text.extension_allowed) == [True]


def test_optional_filter(spark):
    assert column(spark, [None, "", "string", "String", "a"], text.optional_filter) == [None, None, None, "String", "a"]


def test_size_bound(spark):
    assert column(spark, [0, 1_048_576, 1_048_577], text.size_allowed, "long") == [True, True, False]


def test_token_expiry(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 23:50:00' AS t").select(
        text.token_expiry(F.col("t")).cast("string").alias("a"), text.token_expiry(F.col("t"), None).cast("string").alias("b")
    ).first()
    assert (row.a, row.b) == ("2024-01-02 00:20:00", "2024-01-02 00:05:00")


PAGES = {
    "<html><title>T</title><p>a<b>b</b>c</p></html>": "T a b c",
    "<!doctype html><!-- x <p> --><p class='k' id=\"z\">a &amp; b&copy;&nbsp;c</p>": "a & b© c",
    "<script>if (a<b) {'</p>'}</script><style>p{}</style>x": "x",
    "<SCRIPT type=\"a\">y</SCRIPT >x<br/>y": "x y",
    # these need the parser
    "<template>hidden<p>too</p></template>shown": "shown",
    "<a title='1 > 0'>x</a>": "x",
    "a &lt; b &eacute; &#233; &#x41;": "a < b é é A",
    "<p>open <b>never closed": "open never closed",
    "a<ruby>k<rt>reading</rt></ruby>b": "a k b",
    "<template>a<template>b</template>c</template>d": "d",
    "AT&T and &unknown; here": "AT&T and &unknown here",
    "plain text, 3 > 2": "plain text, 3 > 2",
    "": "",
    "<![CDATA[kept]]> x": "kept x",
    "&amp;lt;": "&lt;",
}


def page_texts(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r.text for r in sorted(extract.extract_html(df, "html").collect(), key=lambda r: r.i)]


def test_html(spark):
    got = page_texts(spark, list(PAGES))
    assert [" ".join(g.split()) for g in got] == list(PAGES.values())


def test_html_pattern_path_equals_parser(spark):
    html = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    got = page_texts(spark, html)
    assert [g.split() for g in got] == [extract.page_text(page).split() for page in html]


def test_strict_utf8_keeps_the_bom(spark):
    values = [b"abc", "﻿\xe9".encode(), b"\xff", b"\xed\xa0\x80", b""]
    got = column(spark, [bytearray(v) for v in values], extract.extract_txt, "binary")
    assert got == ["abc", "﻿\xe9", None, None, ""]
