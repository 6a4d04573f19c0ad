"""Main text of pages."""

from __future__ import annotations

import html as entities
import re

from playlog.llm.html_text import extract_text, main_text
from playlog.llm.tables import PAGES, read

PROSE = "word " * 40


def test_pages_of_the_table(spark):
    """The text of the marked article, its blocks found by another way."""
    pages = read(spark, "/root/testdata/sf0.01", "pages", PAGES)
    found = {row["page_id"]: row for row in extract_text(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", row["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li|div)>", article)
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", block)).split()) for block in blocks]
        text = "\n".join(line for line in lines if line)
        assert found[row["page_id"]]["text"] == text
        assert found[row["page_id"]]["n_chars"] == len(text)


def test_unmarked_page_by_surge_and_dive():
    page = f"""<html><head><title>t</title></head><body><div>Home</div><div>News</div><div>Contact</div><div>About us</div>
    <h1>Title</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p>
    <div class="comments"><p>I like this {PROSE}</p></div><div id="sidebar">{PROSE}</div>
    <ul><li><a href="/x">{PROSE}</a></li></ul><footer>{PROSE}</footer></body></html>"""
    assert main_text(page).split("\n")[-4:] == ["Title", PROSE.strip(), "Short.", PROSE.strip()]


def test_markup_that_is_no_text():
    page = """<article><h1>A &amp; B</h1><!-- <p>no</p> --><script>var x = "</p><p>no";</script><style>p{}</style>
    <p title="a > b">one<br>two   three<b>four</b></p><form><p>no</p></form><aside>no</aside><p hidden>no</p>
    <p>&lt;five&gt; &#233; &nbsp; six</article><p>after</p>"""
    assert main_text(page) == "A & B\none two threefour\n<five> é six"


def test_names_of_what_encloses_the_article():
    names = ("content no-sidebar", "has-sidebar", "page-with-header", "share-enabled", "search-results-off")
    for name in names:
        side = f"<div class='related-posts'><article>no</article></div><div class='sidebar'>{PROSE}</div>"
        page = f"<body><div class='{name}'><article><h1>A</h1><p>{PROSE}</p></article>{side}</div></body>"
        assert main_text(page) == f"A\n{PROSE.strip()}"
        assert main_text(f"<div class='{name}'><p>{PROSE}</p></div><footer>no</footer>") == PROSE.strip()
    assert main_text(f"<p>{PROSE}</p><div class='comment-list'><p>{PROSE[:50]}</p></div>") == PROSE.strip()
    assert main_text(f"<div hidden><article>{PROSE}</article></div>") == ""


def test_links_inside_the_article():
    page = f"<article><p>{PROSE}</p><ul><li><a href='/r'>Reference one</a></li></ul></article><p><a href='/n'>next</a></p>"
    assert main_text(page) == f"{PROSE.strip()}\nReference one"


def test_short_and_unmarked_pages():
    text = PROSE.strip()
    assert main_text("<h1>Title</h1><p>Short note.</p>") == "Title\nShort note."
    dated = f"<div>Home</div><div>Contact</div><h1>T</h1><div>3 May 2024</div><div>By Ann</div><p>{PROSE}</p>"
    assert main_text(dated) == f"T\n3 May 2024\nBy Ann\n{text}"
    menu = f"<div>About us</div><div>Contact</div><h1>Title</h1><p>{PROSE}</p><p>Done.</p><div>Copyright 2024 by us.</div><div>Imprint</div>"
    assert main_text(menu) == f"Title\n{text}\nDone."
    assert main_text(f"<h1>Title</h1><p><a href='/x'>{PROSE}</a></p><p>{PROSE}</p>") == f"Title\n{text}\n{text}"
    assert main_text("<div>Home</div><div>News</div>") == ""


def test_parts_of_names_inside_the_article():
    page = f"<article><p class='notice-board'>One.</p><section class='tags-and-facts'><p>Two.</p></section><p>{PROSE}</p><div class='share'>no</div></article>"
    assert main_text(page) == f"One.\nTwo.\n{PROSE.strip()}"


def test_long_broken_pages_take_linear_time():
    import time

    many = 1_000_000
    pages = ["<a ", '<a "', "<a \">\" ", "<!x ", "<svg>", "</script ", "<script></script ", "<b>", "</i>", "<p", "<!--", "<", "</p>", "< ", "<a '"]
    for piece in pages:
        page = piece * (many // len(piece))
        began = time.process_time()
        assert isinstance(main_text(page), str)
        assert time.process_time() - began < 12, piece
    page = "<b>" * 100_000 + "</i>" * 100_000
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 6


def test_broken_pages():
    for page in ("", "<", "<p", "<article>", "</p></div>", "<!--", "<script>", "<p a='", "&amp", "<a" * 2000, "<b>" * 5000):
        assert isinstance(main_text(page), str)
    assert main_text(f"<article><p>{PROSE}").strip() == PROSE.strip()
    assert len(main_text("<article>" + "<p><b>x" * 20_000).split("\n")) == 20_000


def test_rows(spark):
    rows = [(1, "u", None, 9), (2, None, "", 9), (None, "v", f"<article><p>{PROSE}</p></article>", 9), (3, "w", "<p>x</p>", 9)]
    pages = spark.createDataFrame(rows + rows[2:3], "page_id bigint, url string, html string, n_chars int")
    found = sorted((tuple(row) for row in extract_text(pages).collect()), key=repr)
    text = PROSE.strip()
    expected = [(1, "u", "", 0), (2, None, "", 0), (3, "w", "", 0), (None, "v", text, len(text)), (None, "v", text, len(text))]
    assert found == sorted(expected, key=repr)
    assert extract_text(pages.limit(0)).count() == 0
