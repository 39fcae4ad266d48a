"""Wrapper induction on pages that are hard to read or to align."""

import time

import pytest

from ledgerspark.llm import html_extract as H


def text(page):
    return " ".join(H.blocks(H.parse(page))[0])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>A</article><p>no<article>B</article>", "A B"),
        ("<div class='content has-sidebar'><p>T</div>", "T"),
        ("<div id='main-with-menu'>T</div>", "T"),
        ("<div class='sidebar'><main>T</main></div>", "T"),
        ("<div class='cookie-notice'>N</div>T", "T"),
        ("<article>T<div class='comment-list'><article>c</article></div></article>", "T"),
        ("<p title='a>b'>x<p title=\"c>y", "x y"),
        ("<p class='x hidden y'>T<p hidden>h", "T"),
        ("a < b &lt; c<!-- d", "a < b < c"),
        ("<main></main><p>T", "T"),
    ],
)
def test_regions(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page", ["<a " * 300_000, '<a ">"' * 100_000, "<a " + "x" * 1_000_000 + ">t", "<div>x" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<div>" * 50_000 + "</section>" * 50_000, "<p>x" * 20_000, "<script>" * 20_000, "<ul><li>x" * 20_000])
def test_hostile_pages(page):
    start = time.time()
    tree = H.blocks(H.parse(page))[1]
    H.match(tree, H.blocks(H.parse("<h1>q</h1>" + page + "<p>z"))[1], {}, {})
    assert time.time() - start < 15


def test_template_at_its_node_only(spark):
    """A constant heading goes, a list item that equals it stays, and no partitioning changes a text."""
    pages = []
    for i in range(40):
        item = "<li>Summary" if i == 3 else ""
        body = "".join(f"<p>Body {i} {j}</p>" for j in range(1 + i % 5))
        pages.append((i, f"http://a.example/{i}", f"<body><h2>Summary</h2>{body}<ul><li>alpha {i}{item}</ul><h6>End of text</h6></body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got[3] == "Body 3 0 Body 3 1 Body 3 2 Body 3 3 alpha 3 Summary"
    assert all("End" not in t for t in got.values())
    for n in (1, 17):
        assert {r["page_id"]: r["text"] for r in H.extract(df.repartition(n)).collect()} == got


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
