import html
import re
import time

import pytest
from passagelake.llm.html_text import extract, main_text

PARAGRAPH = "Slow rivers carve the valley floor, and leave gravel bars behind them."


def article(page):
    """Plain reading of the given pages: headings and paragraphs of the article."""
    inner = re.search("<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(filter(None, blocks))


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    rows = extract(pages).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize(
    "page, text",
    [
        (
            f"<body><header><h1>Site</h1><p>tag line, yes.</p></header><div class='cookie-notice'><p>{PARAGRAPH}</p></div><div id=content><h1>Title</h1>"
            f"<p>{PARAGRAPH} <a href=x>See</a> here.</p><ul><li>one<li>two</ul><form><p>Name</p></form><p>Short.</p><div class=share><a>x</a></div></div>"
            f"<div class=sidebar><p>{PARAGRAPH}</p></div><section id=comments><p>{PARAGRAPH} {PARAGRAPH} {PARAGRAPH}</p></section><footer>c</footer>",
            f"Title\n{PARAGRAPH} See here.\none\ntwo\nShort.",
        ),
        (f"<p>{PARAGRAPH}<p>{PARAGRAPH}", f"{PARAGRAPH}\n{PARAGRAPH}"),
        (f"<main><p>{PARAGRAPH}</p><aside>{PARAGRAPH}</aside></main>", PARAGRAPH),
        ("<article><p>a&amp;b &lt;i&gt; &eacute;&#233;&nbsp;c\n\t d</p></article>", "a&b <i> éé c d"),
        ("<article><p>x<script>if (a<b) '</p>'</script>y</p><style>p{}</style></article>", "xy"),
        ("<article><p>one<!-- two --> three</p></article><!-- open", "one three"),
        ("<article><p>cut off</p><p cla", "cut off"),
        ("<nav><a>x</a></nav>", ""), ("", ""), ("plain text", "plain text"), ("<table><tr><td>One.<td>Two.</table>", "One.\nTwo."),
        ("<article>" + "<div>" * 3_000 + "deep" + "</div>" * 3_000 + "</article>", "deep"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='layout has-sidebar'><article><p>{PARAGRAPH}</p></article><div class=sidebar><p>{PARAGRAPH}</p></div></div>", PARAGRAPH),
        (f"<div class='content no-comments'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>", f"{PARAGRAPH}\n{PARAGRAPH}"),
        (f"<div id=page class='left-sidebar'><article><p>{PARAGRAPH}</p></article><div class=comments><p>{PARAGRAPH}</p></div></div><p>Legal.</p>", PARAGRAPH),
        (f"<div id=page class='left-sidebar'><div id=content><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div></div>", f"{PARAGRAPH}\n{PARAGRAPH}"),
        (f"<article><header class='entry-header'><h1>Title</h1></header><div class='section-header'><h2>Part</h2></div><p>{PARAGRAPH}</p></article>", f"Title\nPart\n{PARAGRAPH}"),
        (f"<article><p>{PARAGRAPH}</p></article><div class=related><article><p>{PARAGRAPH} {PARAGRAPH}</p></article></div>", PARAGRAPH),
        (f"<div id=content><p>{PARAGRAPH}</p></div><ol class=comments><li><article class='comment-body'><p>{PARAGRAPH} {PARAGRAPH}</p></article></ol>", PARAGRAPH),
    ],
)
def test_names_of_frames_and_headers(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("count", [1, 3, 5, 12])
def test_lists_in_the_main_text_stay(count):
    linked, plain = ("".join(f"<li>{t}" for _ in range(count)) for t in ("<a href=x>Source</a>", "short item"))
    prose = f"<p>{PARAGRAPH}</p>" * 3
    lines = [PARAGRAPH] * 3
    assert main_text(f"<article>{prose}<ul>{linked}</ul></article>").split("\n") == lines + ["Source"] * count
    assert main_text(f"<div>{prose}<ul>{linked}</ul>{prose}</div>").split("\n") == lines + ["Source"] * count + lines
    for items, text in ((linked, "Source"), (plain, "short item")):
        assert main_text(f"<body>{prose}<ul>{items}</ul>{prose}<nav>x</nav></body>").split("\n") == lines + [text] * count + lines


@pytest.mark.parametrize("name", ["share-price", "side-effects", "search_results2", "notice-period"])
def test_names_that_only_begin_like_other_parts(name):
    page = f"<article><p>{PARAGRAPH}</p><div class='{name}'><p>It rose, then fell.</p></div><p>{PARAGRAPH}</p></article>"
    assert main_text(page).split("\n") == [PARAGRAPH, "It rose, then fell.", PARAGRAPH]
    links = f"<article><p>{PARAGRAPH}</p><div class='{name}'><a href=x>Rose, fell.</a></div></article>"
    assert main_text(links) == PARAGRAPH


@pytest.mark.parametrize("name", ["share", "share-buttons", "reader-comments", "comment-42", "cookie-policy-notice", "ad-slot", "sidebar-left", "promo_box"])
def test_names_of_other_parts_inside_an_article(name):
    assert main_text(f"<article><p>{PARAGRAPH}</p><div class='{name}'><p>It rose, then fell.</p></div></article>") == PARAGRAPH


def test_text_behind_the_last_content_stays():
    page = f"<body><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div>short</div><ul><li>tail item</li></ul><div class=more><a href=x>Next</a></div></body>"
    assert main_text(page).split("\n") == [PARAGRAPH, PARAGRAPH, "short", "tail item"]


@pytest.mark.parametrize("unit", ["<div>x. ", "<div class=sidebar><h1>x. ", "<b>x. <div>y. ", "<span>", "</p><i>x. </b>"])
def test_nested_pages_cost_as_much_as_flat_ones(unit):
    begin = time.process_time()
    assert bool(main_text("<body>" + unit * 10_000)) == ("x" in unit)
    assert time.process_time() - begin < 3


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, f"<article><p>{PARAGRAPH * 3_000}</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = sorted((r.page_id or 0, r.n_chars) for r in extract(pages).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, len(PARAGRAPH) * 3_000)]
    assert extract(pages.limit(0)).count() == 0
