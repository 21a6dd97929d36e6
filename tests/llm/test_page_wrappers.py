import pytest

from tickloom.llm import page_text

NODE = page_text.tree()
LONG = "This is a paragraph of some length that goes on about one thing and another until it ends here at last. " * 2
ONE = LONG.strip()


def text(page):
    return page_text.main_text(page, NODE)


@pytest.mark.parametrize("wrapper", [
    "<div class='layout has-sidebar'>", "<div class='content-sidebar-wrap'>", "<div id='page' class='with-header'>", "<form method=post action='x.aspx'>",
    "<div class='sidebar'>", "<div class='no-sidebar header-wrap'>", "<div class='paywall'>",
])
def test_a_wrapper_does_not_take_the_article_with_it(wrapper):
    end = "</" + wrapper[1:].split()[0] + ">"
    inside = f"<nav><a href='/'>Home</a></nav><article><h1>A title</h1><p>{LONG}</p><aside>{LONG}</aside></article><footer>{LONG}</footer>"
    assert text(f"<body>{wrapper}{inside}{end}</body>") == f"A title\n\n{ONE}"
    assert text(f"<body>{wrapper}<main><p>{LONG}</p></main>{end}</body>") == ONE


@pytest.mark.parametrize("furniture", [
    f"<aside><article><p>{LONG}</p></article></aside>", f"<div class='comments'><article><p>{LONG}</p></article></div>", f"<article class='comment'><p>{LONG}</p></article>",
    f"<div class='cookie-notice'><div class='content'>{LONG}</div></div>", f"<div class='post-comments'>{LONG}</div>", f"<nav><div class='content'>{LONG}</div></nav>",
    f"<div style='display:none'><article>{LONG}</article></div>",
])
def test_what_is_not_the_page_s_own_still_goes(furniture):
    assert text(f"<body><article><p>{LONG}</p></article>{furniture}</body>") == ONE


def test_linked_headings_and_paragraphs_stay_and_lists_of_links_go():
    menu = "<nav><a href=1>Home</a></nav>"
    assert text(f"{menu}<article><h1><a href='/x'>Title</a></h1><p>{LONG}</p></article>") == f"Title\n\n{ONE}"
    assert text(f"<article><p>{LONG}</p><p><a href='/x'>All of it is a link</a></p><p>{LONG}</p></article>") == f"{ONE}\n\nAll of it is a link\n\n{ONE}"
    links = "".join(f"<li><a href={i}>More of this {i}</a></li>" for i in range(4))
    assert text(f"<article><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p></article>") == f"{ONE}\n\n{ONE}"


@pytest.mark.parametrize("anchor", ["<a name=top>", "<a href='/x'>"])
def test_an_anchor_that_is_never_closed_ends_with_its_block(anchor):
    rest = "".join(f"<p>Paragraph {i}</p>" for i in range(5))
    want = "".join(f"\n\nParagraph {i}" for i in range(5))
    assert text(f"<article><p>{anchor}Here</p>{rest}</article>") == "Here" + want
    assert text(f"<article><h2>{anchor}Here</h2>{rest}</article>") == "Here" + want


def test_an_anchor_around_blocks_links_them_all():
    card = "<a href='/x'><h3>One</h3><p>two words</p></a>"
    assert [b[1] == b[2] for b in page_text.blocks(f"<div>{card}<p>not linked</p></div>")] == [True, True, False]


@pytest.mark.parametrize("opening", [
    '<section id="discussion">', '<section id="related-work">', '<section id="notices">', '<div class="social-science">', '<table class="ad-hoc">', '<div class="comments-off">',
])
def test_names_that_only_hold_a_word_of_furniture_mark_nothing(opening):
    closing = "</" + opening[1:].split()[0] + ">"
    assert text(f"<article><p>{LONG}</p>{opening}<p>{LONG}</p>{closing}</article>") == f"{ONE}\n\n{ONE}"


@pytest.mark.parametrize("name", ["comments-list", "site-footer", "footer-links", "widget-area", "acme-sidebar", "newsletterSignup", "social share"])
def test_names_of_furniture_with_words_around_still_mark_it(name):
    assert text(f'<article><p>{LONG}</p><div class="{name}"><p>{LONG}</p></div></article>') == ONE


def test_pages_without_any_sign_go_by_words_and_links():
    """The table's pages with section elements and attributes taken out: the neighbours decide, no foreign block, few blocks lost."""
    import re

    import pyarrow.parquet as pq

    pages = [p["html"] for p in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    foreign, kept, all_, equal = 0, 0, 0, 0
    for page in pages:
        bare = re.sub(r"<(/?)(?:nav|header|footer|aside|article|main|section|form)\b[^>]*>", r"<\1div>", page)
        bare = re.sub(r"<div [^>]*>", "<div>", bare)
        want, got = text(page).split("\n\n"), text(bare).split("\n\n")
        foreign += any(b not in want for b in got)
        kept, all_, equal = kept + sum(b in got for b in want), all_ + len(want), equal + (got == want)
    assert foreign <= len(pages) / 10 and kept >= 0.95 * all_ and equal >= len(pages) / 2
