"""Main text of pages."""

import html
import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import extraction
from tidewell.llm.blocks import blocks
from tidewell.llm.html_examples import labelled_pages

DATA = "/root/testdata/sf0.01"


def text(page):
    return extraction.main_text(page, extraction.block_tree())


def test_the_tree_learns_its_table():
    tree = extraction.block_tree()
    for page, labels in labelled_pages():
        found = blocks(page)
        kept = [int(extraction.decide(tree, row)) for row in extraction.features(found)]
        assert kept == labels, page[:100]


def test_blocks_and_references():
    page = (
        "<nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1>\n<p>one <b>two</b>\n three&nbsp;four<br>five"
        "<p>1 < 2 &#x263A;</p><!-- <p>no</p> --><script>var a = '<p>no</p>';</script></article><footer>f</footer>"
    )
    assert text(page) == "A & B\none two three four five\n1 < 2 ☺"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "</p></p>", "<script>x", "<!-- x", "<a href='x>y", "&", "<head><p>"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(text(page), str)


def test_furniture_inside_and_around():
    page = (
        "<body><header>Site</header><div id=cookie-notice><p>We use many small cookies here for you.</p></div><main>"
        "<p>First words of it.</p><div class='comments'><p>I like this very much, thank you all for writing it down.</p></div>"
        "<form><p>Give your address</p></form><p>Last words of it.</p></main><aside><p>Other things that we wrote.</p></aside></body>"
    )
    assert text(page) == "First words of it.\nLast words of it."


def test_marks_end_where_their_elements_do():
    page = (
        "<div class='page has-sidebar'><article><p class=notice>This is a notice for you.<p>First words.<ul><li class=ad>Buy now"
        "<li>One thing</ul><p>Last words.</article></div>"
    )
    assert text(page) == "First words.\nOne thing\nLast words."


LONG = "Many people came down to the river that day and waited for the boats until it was dark and cold. " * 3


@pytest.mark.parametrize(
    "page",
    [
        "<body><form id=aspnetForm><nav><a href=/>Home</a></nav><main><h1>Title here</h1><p>{}</p></main></form></body>",
        "<body><div class='page-header widget'><article><h1>Title here</h1><p>{}</p></article></div></body>",
        "<body><form id=aspnetForm><nav><a href=/>Home</a></nav><div><h1>Title here</h1><p>{0}</p><p>{0}</p></div></form></body>",
    ],
)
def test_marks_around_the_article_end_at_it(page):
    found = text(page.format(LONG))
    assert LONG.strip() in found and "Home" not in found


def test_articles_in_comments_stay_furniture():
    page = "<main><p>First words of it.</p></main><div id=comments><article><p>I like this very much, thank you all.</p></article></div>"
    assert text(page) == "First words of it."


@pytest.mark.parametrize("name", ["object", "canvas", "audio", "video", "svg", "select", "iframe", "template", "noscript"])
def test_a_missing_end_tag_does_not_end_the_page(name):
    assert text(f"<article><p>First words.</p><{name}><p>Last words.</p></article>").endswith("Last words.")


def test_formulas_are_read():
    page = "<article><p>Here <math><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow></math> holds.</p></article>"
    assert text(page) == "Here a=2 holds."


def plain(page):
    article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:h1|p)>", article)]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    want = pages.collect()
    assert len(got) == len(want)
    for row in want:
        found = got[row.page_id]
        assert (found.url, found.text, found.n_chars) == (row.url, plain(row.html), len(found.text))
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "")], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in extraction.extract(odd.where("page_id = 1")).collect()) == [(1, None, "", 0)] * 2
    assert extraction.extract(odd.where("false")).count() == 0
