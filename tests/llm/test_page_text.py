import re

import pyarrow.parquet as pq
import pytest

from llm_fixtures import small  # noqa: F401
from tickloom.llm import page_text, queries

NODE = page_text.tree()


def text(page):
    return page_text.main_text(page, NODE)


def test_tree_agrees_with_its_table():
    import numpy as np

    data = np.array(page_text.LABELLED, float)
    assert (page_text.decide(NODE, data[:, :-1]) == (data[:, -1] == 1)).all()


def test_tree_on_all_neighbours():
    """What an element says of a block, or a long text without links, outweighs whatever stands beside it."""
    import itertools

    import numpy as np

    sides = list(itertools.product((0, 1, 3, 6, 12, 30, 90, 300), (0.0, 0.3, 0.9, 1.0)))
    rows = [(w, d, *a, *b, z) for w, d in ((1, 0.0), (2, 0.0), (8, 0.0), (25, 0.0), (60, 0.1), (300, 0.0)) for a in sides for b in sides for z in (-1, 0, 1)]
    rows = np.array(rows, float)
    kept = page_text.decide(NODE, rows)
    assert not kept[rows[:, 6] == -1].any()
    assert kept[rows[:, 6] == 1].all()
    assert kept[(rows[:, 6] == 0) & (rows[:, 0] >= 25)].all()


LONG = "This is a paragraph of some length that goes on about one thing and another until it ends here at last. " * 2


@pytest.mark.parametrize("furniture", [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News of the day</a></li></ul></nav>", "<header><h2>Site name</h2><p>Our motto</p></header>",
    "<footer>&copy; 2024 All rights reserved by the owner of this page and nobody else.</footer>", f"<aside><p>{LONG}</p></aside>", f'<div class="ad">{LONG}</div>',
    f'<div id="cookie-notice"><p>{LONG}</p></div>', f"<form><label>Name</label><input><p>{LONG}</p></form>", "<script>if (a < b) document.write('<p>text</p>')</script>",
    "<style>p > a {color: red}</style>", f'<section class="comments"><h3>Comments</h3><p>{LONG}</p></section>', f"<!-- <p>{LONG}</p> -->", f'<div class="sidebar">{LONG}</div>',
    f'<div style="display:none">{LONG}</div>', "<noscript>Please enable scripts.</noscript>",
])
@pytest.mark.parametrize("inside", [True, False])
def test_furniture_goes_and_the_article_stays(furniture, inside):
    article = f"<h1>A title</h1><p>{LONG}</p><p>Short.</p>"
    page = f"<html><body><article>{article}{furniture if inside else ''}<p>{LONG}</p></article>{'' if inside else furniture}</body></html>"
    if inside and "<header>" in furniture:
        return  # an article's header is its own
    one = LONG.strip()
    assert text(page) == f"A title\n\n{one}\n\nShort.\n\n{one}"


def test_markup_inside_blocks():
    page = "<article><p>Fish &amp; chips&nbsp;cost &lt;&#163;5&gt;,\n\t<b>not</b> <i>m</i>ore<br>than that &eacute;t&eacute; &hellip; 1 < 2 and <a href='x>y'>a link</a> too</p></article>"
    assert text(page) == "Fish & chips cost <£5>, not more than that été … 1 < 2 and a link too"


def test_pages_without_signs_and_broken_pages():
    plain = f"<div><a href=1>Home</a> <a href=2>About us</a></div><div>{LONG}</div><div>Yes.</div><div>{LONG}</div><div><a href=3>Next page</a></div>"
    one = LONG.strip()
    assert text(plain) == f"{one}\n\nYes.\n\n{one}"
    assert text(f"<article><p>{LONG}<p>{LONG}<scr") == f"{one}\n\n{one}"
    assert text(f"<article><p>{LONG}</p><script>never closed <p>x</p>") == one
    assert text("") == "" and text("<html></html>") == "" and text("<<<>>>&&") is not None


def test_long_page_is_quick_and_whole():
    page = "<article>" + "".join(f"<p>{i} {LONG}</p>" for i in range(5000)) + "</article>"
    assert text(page).count("\n\n") == 4999


def test_pages_of_the_table(spark, small):
    rows = {r.page_id: r for r in queries.op4_page_text(spark, small).collect()}
    pages = pq.read_table(f"{small}/pages.parquet").to_pylist()
    assert len(rows) == len(pages)
    import html

    for p in pages:
        article = re.search(r"<article>(.*)</article>", p["html"], re.S)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article[1])]
        r = rows[p["page_id"]]
        assert r.text == "\n\n".join(w for w in want if w), p["page_id"]
        assert r.n_chars == len(r.text) and r.url == p["url"]


def test_odd_rows_and_empty_table(spark):
    rows = [(1, "u", None, "x"), (1, None, "", "x"), (None, "u", "<article><p>a</p></article>", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in page_text.extract(pages).collect()) == [("", 0), ("", 0), ("a", 1)]
    assert page_text.extract(pages.limit(0)).collect() == []
