"""Main text of pages whose furniture outweighs the article, of deep pages, and of empty tables."""

import time

import pytest

from echogrid.llm.extract import extracted, main_text

ARTICLE = "".join(f"<p>Article sentence number {k} tells the reader something of weight, at length.</p>" for k in range(8))
OTHER = "".join(f"<p>Comment sentence {k} where a reader says what they think of the story at length.</p>" for k in range(24))
LAYOUTS = {
    "comments beside the article": "<article><h1>T</h1>{a}</article><div class='comments-area'>{o}</div>",
    "comments section in the article": "<article><h1>T</h1>{a}<section id='comments'>{o}</section></article>",
    "comments block in the article": "<article><h1>T</h1>{a}<div class='comments-area'>{o}</div></article>",
    "no article element": "<div class='post'>{a}</div><div id='comments'>{o}</div>",
    "comment list": "<div class='post'>{a}</div><ol class='comment-list'>{o}</ol>",
    "comments as articles": "<article>{a}</article><div class='comments'><article class='comment'>{o}</article></div>",
    "sidebar": "<div class='sidebar-left'>{o}</div><div class='post'>{a}</div>",
    "sidebar beside the article": "<article>{a}</article><div class='left-sidebar-area'>{o}</div>",
    "form": "<article>{a}</article><form>{o}</form>",
    "notice": "<div class='cookie-wall'>{o}</div><div>{a}</div>",
    "wrapper": "<div class='has-sidebar'><div class='sidebar'>{o}</div><div>{a}</div></div>",
    "wrapper below a name": "<div id='brand'>My Site</div><div class='has-sidebar'><article>{a}</article><div class='comments'>{o}</div></div>",
    "form around the page": "<form id='aspnetForm'><div class='menu'>{o}</div><div>{a}</div></form>",
    "named article": "<article class='social-science'>{a}</article>",
    "named wrapper": "<div id='no-comments'>{a}</div>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_furniture_goes_whatever_its_size(layout):
    text = main_text("<html><body>" + LAYOUTS[layout].format(a=ARTICLE, o=OTHER) + "</body></html>")
    assert (text.count("Article sentence"), text.count("Comment sentence")) == (8, 0)


def test_head_of_an_article_stays():
    assert main_text(f"<article><div class='entry-header'><h1>Heading</h1></div>{ARTICLE}</article>").startswith("Heading Article")


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x" + "</div>" * 20_000, "<p>" + "<span>" * 20_000 + "x" + "</span>" * 20_000, "<div>" * 20_000 + "x" + "</em>" * 20_000,
                                  "<nav>" + "<div>" * 20_000 + "</div>" * 20_000 + "</nav>x", "x<b><div>" + "<i>" * 20_000 + "</b>" * 20_000])
def test_time_does_not_grow_with_the_square_of_nesting(page):
    start = time.perf_counter()
    assert main_text(page) == "x"
    assert time.perf_counter() - start < 10


def test_rows_nulls_and_empty_tables(spark):
    kind = "page_id long, url string, html string, text int, n_chars string"
    rows = [(1, None, None, 1, "x"), (None, "u", "", 1, "x"), (2, "u", "<p>A &amp; b</p>" * 3, 1, "x"), (2, "u", "<p>A &amp; b</p>" * 3, 1, "x"), (3, "v", "<article>" + "<p>long text</p>" * 50_000 + "</article>", 1, "x")]
    got = extracted(spark.createDataFrame(rows, kind))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.url, r.text[:20], r.n_chars) for r in got.collect()) == [
        ("1", None, "", 0), ("2", "u", "A & b A & b A & b", 17), ("2", "u", "A & b A & b A & b", 17), ("3", "v", "long text long text ", 499_999), ("None", "u", "", 0)]
    assert extracted(spark.createDataFrame([], kind)).count() == 0
