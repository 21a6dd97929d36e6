"""Main text of HTML pages by flat text blocks and a decision tree.

A page is cut into text blocks in page order.  A block's features are its word
count and link density, those of the blocks before and after it, and whether
it lies in an element that says it is content or furniture.  A decision tree,
grown from the small labelled table below, keeps or drops it.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Labelled by hand: words and link density of a block, of the one before, of the one after; zone (1 in content, -1 in
# furniture, 0 unknown); 1 for main text.
LABELLED = [
    # Furniture by its element, whatever it says.
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 0), (1, 1.0, 1, 1.0, 8, 0.0, -1, 0), (8, 0.0, 1, 1.0, 10, 0.0, -1, 0), (60, 0.0, 1, 1.0, 50, 0.0, -1, 0),
    (40, 0.0, 80, 0.0, 0, 0.0, -1, 0), (12, 0.0, 60, 0.0, 0, 0.0, -1, 0), (3, 0.0, 3, 0.0, 3, 0.0, -1, 0), (150, 0.02, 20, 0.0, 30, 0.0, -1, 0),
    (25, 0.1, 120, 0.0, 25, 0.1, -1, 0), (5, 0.4, 40, 0.0, 6, 0.5, -1, 0), (2, 0.0, 200, 0.0, 15, 0.0, -1, 0), (18, 0.0, 0, 0.0, 12, 0.0, -1, 0),
    # Paragraphs, headings and short lines of an article.
    (12, 0.0, 8, 0.0, 90, 0.0, 1, 1), (90, 0.0, 12, 0.0, 60, 0.0, 1, 1), (60, 0.02, 90, 0.0, 2, 0.0, 1, 1), (2, 0.0, 60, 0.0, 70, 0.0, 1, 1),
    (1, 0.0, 30, 0.0, 1, 0.0, 1, 1), (1, 0.0, 1, 0.0, 12, 0.0, 1, 1), (70, 0.0, 2, 0.0, 14, 0.0, 1, 1), (5, 0.0, 1, 1.0, 0, 0.0, 1, 1),
    (25, 0.3, 60, 0.0, 50, 0.0, 1, 1), (8, 0.5, 50, 0.0, 50, 0.0, 1, 1), (300, 0.05, 8, 0.0, 10, 0.2, 1, 1), (14, 0.0, 8, 0.0, 10, 0.0, 1, 1),
    (3, 0.0, 10, 0.0, 12, 0.4, 1, 1), (40, 0.6, 80, 0.0, 30, 0.0, 1, 1), (3, 0.0, 1, 1.0, 1, 1.0, 1, 1),
    (40, 0.0, 40, 0.0, 1, 1.0, 1, 1), (2, 0.0, 40, 0.0, 4, 1.0, 1, 1), (6, 0.0, 60, 0.0, 2, 1.0, 1, 1), (90, 0.0, 2, 1.0, 3, 1.0, 1, 1),
    (45, 0.0, 3, 0.0, 2, 0.6, 1, 1), (110, 0.0, 1, 0.0, 30, 0.9, 1, 1), (1, 0.0, 5, 1.0, 80, 0.0, 1, 1), (16, 0.0, 0, 0.0, 0, 0.0, 1, 1),
    (400, 0.0, 0, 0.0, 0, 0.0, 1, 1), (7, 0.0, 7, 0.9, 7, 0.9, 1, 1), (30, 0.4, 2, 0.0, 4, 1.0, 1, 1), (4, 0.25, 90, 0.0, 90, 0.0, 1, 1),
    (1, 0.0, 12, 1.0, 3, 0.0, 1, 1), (2, 0.0, 3, 1.0, 4, 0.0, 1, 1), (8, 0.0, 90, 1.0, 3, 0.0, 1, 1), (25, 0.0, 6, 1.0, 3, 0.0, 1, 1), (60, 0.1, 3, 1.0, 3, 0.0, 1, 1),
    # Headings, paragraphs and short lines of an article that are wholly a link.
    (4, 1.0, 0, 0.0, 60, 0.0, 1, 1), (6, 1.0, 0, 0.0, 12, 0.0, 1, 1), (8, 1.0, 0, 0.0, 90, 0.02, 1, 1), (4, 1.0, 60, 0.0, 60, 0.0, 1, 1), (9, 1.0, 40, 0.0, 12, 0.0, 1, 1),
    (20, 1.0, 60, 0.0, 0, 0.0, 1, 1), (3, 1.0, 90, 0.0, 2, 0.0, 1, 1), (12, 0.95, 30, 0.1, 45, 0.3, 1, 1), (2, 1.0, 12, 0.0, 8, 0.0, 1, 1), (5, 1.0, 8, 0.5, 0, 0.0, 1, 1),
    (1, 1.0, 0, 0.0, 40, 0.0, 1, 1), (2, 1.0, 0, 0.0, 20, 0.0, 1, 1), (7, 1.0, 0, 0.0, 3, 0.6, 1, 1), (10, 1.0, 0, 0.0, 0, 0.0, 1, 1), (1, 1.0, 5, 0.6, 200, 0.0, 1, 1), (60, 1.0, 90, 0.0, 90, 0.0, 1, 1),
    # Lists of links inside an article.
    (6, 1.0, 0, 0.0, 5, 1.0, 1, 0), (3, 1.0, 5, 1.0, 0, 0.0, 1, 0), (4, 1.0, 4, 1.0, 60, 0.0, 1, 0), (7, 1.0, 3, 1.0, 30, 0.0, 1, 0), (5, 1.0, 90, 0.0, 4, 0.95, 1, 0), (5, 1.0, 4, 0.95, 90, 0.0, 1, 0),
    (4, 1.0, 60, 0.0, 5, 1.0, 1, 0), (5, 1.0, 4, 1.0, 3, 1.0, 1, 0), (9, 1.0, 5, 1.0, 12, 0.0, 1, 0), (2, 1.0, 40, 0.0, 3, 1.0, 1, 0), (12, 0.95, 10, 1.0, 8, 1.0, 1, 0),
    # Pages without any sign: long texts with few links, and what stands among them.
    (80, 0.0, 3, 1.0, 60, 0.0, 0, 1), (60, 0.05, 80, 0.0, 40, 0.0, 0, 1), (40, 0.1, 60, 0.0, 5, 0.0, 0, 1), (22, 0.0, 1, 1.0, 90, 0.0, 0, 1),
    (18, 0.0, 60, 0.0, 70, 0.0, 0, 1), (9, 0.0, 2, 1.0, 70, 0.0, 0, 1), (5, 0.0, 70, 0.0, 60, 0.0, 0, 1), (2, 0.0, 45, 0.0, 50, 0.0, 0, 1),
    (12, 0.0, 50, 0.0, 30, 0.0, 0, 1), (30, 0.2, 30, 0.0, 30, 0.1, 0, 1), (200, 0.1, 4, 0.0, 4, 0.0, 0, 1), (35, 0.0, 4, 0.5, 3, 0.0, 0, 1),
    (26, 0.25, 90, 0.0, 40, 0.0, 0, 1), (7, 0.0, 30, 0.0, 25, 0.0, 0, 1), (40, 0.0, 2, 0.0, 3, 1.0, 0, 1), (40, 0.0, 60, 0.0, 2, 1.0, 0, 1),
    (25, 0.0, 60, 0.0, 3, 1.0, 0, 1), (120, 0.05, 3, 1.0, 3, 1.0, 0, 1), (30, 0.1, 1, 1.0, 1, 1.0, 0, 1), (45, 0.0, 1, 0.0, 2, 1.0, 0, 1),
    (70, 0.0, 5, 0.0, 1, 0.5, 0, 1), (55, 0.0, 0, 0.0, 4, 1.0, 0, 1), (250, 0.0, 1, 1.0, 0, 0.0, 0, 1), (24, 0.0, 24, 0.0, 24, 0.9, 0, 1),
    # A notice between the menu and the heading, the heading behind it, and the line at the page's foot.
    (8, 0.0, 1, 1.0, 12, 0.0, 0, 0), (10, 0.0, 1, 1.0, 14, 0.0, 0, 0), (14, 0.0, 1, 1.0, 11, 0.0, 0, 0), (6, 0.0, 1, 1.0, 13, 0.0, 0, 0), (11, 0.0, 2, 1.0, 9, 0.0, 0, 0),
    (17, 0.0, 1, 1.0, 13, 0.0, 0, 0), (13, 0.0, 3, 1.0, 16, 0.0, 0, 0), (12, 0.0, 10, 0.0, 90, 0.0, 0, 1), (14, 0.0, 8, 0.0, 40, 0.0, 0, 1), (13, 0.0, 9, 0.0, 20, 0.0, 0, 1),
    (11, 0.0, 15, 0.0, 30, 0.0, 0, 1), (16, 0.0, 6, 0.0, 18, 0.0, 0, 1), (12, 0.0, 90, 0.0, 0, 0.0, 0, 0), (10, 0.0, 60, 0.0, 0, 0.0, 0, 0), (16, 0.0, 200, 0.0, 0, 0.0, 0, 0),
    (14, 0.0, 30, 0.0, 0, 0.0, 0, 0), (11, 0.0, 18, 0.0, 0, 0.0, 0, 0), (18, 0.0, 120, 0.0, 0, 0.0, 0, 0), (19, 0.0, 60, 0.0, 12, 0.0, 0, 1), (16, 0.0, 20, 0.0, 14, 0.0, 0, 1),
    (12, 0.0, 0, 0.0, 60, 0.0, 0, 1), (13, 0.0, 1, 1.0, 80, 0.0, 0, 1), (11, 0.0, 1, 1.0, 45, 0.0, 0, 1),
    # Short paragraphs and headings among other text.
    (6, 0.0, 8, 0.0, 13, 0.0, 0, 1), (13, 0.0, 6, 0.0, 68, 0.0, 0, 1), (8, 0.0, 26, 0.0, 11, 0.0, 0, 1), (11, 0.0, 8, 0.0, 49, 0.0, 0, 1), (1, 0.0, 61, 0.0, 3, 0.0, 0, 1),
    (3, 0.0, 5, 0.0, 48, 0.0, 0, 1), (2, 0.0, 12, 0.0, 19, 0.0, 0, 1), (4, 0.0, 35, 0.0, 15, 0.0, 0, 1), (9, 0.0, 10, 0.0, 8, 0.0, 0, 1), (2, 0.0, 9, 0.0, 32, 0.0, 0, 1),
    (14, 0.0, 24, 0.0, 43, 0.0, 0, 1), (6, 0.0, 13, 0.0, 9, 0.0, 0, 1), (12, 0.0, 54, 0.0, 4, 0.0, 0, 1), (5, 0.0, 74, 0.0, 4, 0.0, 0, 1), (4, 0.0, 5, 0.0, 12, 0.0, 0, 1),
    # And their menus, captions, notes and feet.
    (1, 1.0, 0, 0.0, 2, 1.0, 0, 0), (3, 1.0, 1, 1.0, 1, 1.0, 0, 0), (30, 0.9, 2, 1.0, 5, 0.8, 0, 0), (60, 0.7, 4, 1.0, 20, 0.9, 0, 0),
    (4, 0.0, 1, 1.0, 3, 1.0, 0, 0), (6, 0.0, 70, 0.0, 0, 0.0, 0, 0), (10, 0.1, 60, 0.0, 3, 1.0, 0, 0), (12, 0.5, 3, 1.0, 10, 0.6, 0, 0),
    (3, 0.0, 2, 0.0, 2, 0.0, 0, 0), (8, 0.3, 6, 0.0, 4, 0.5, 0, 0), (2, 0.0, 0, 0.0, 3, 0.0, 0, 0), (13, 0.0, 4, 0.3, 2, 0.0, 0, 0),
    (9, 0.0, 80, 0.0, 1, 0.0, 0, 0), (20, 0.45, 5, 1.0, 30, 0.0, 0, 0), (5, 0.6, 40, 0.0, 40, 0.0, 0, 0),
]

# Elements and words in class, id or role that mark furniture or content.
FURNITURE_TAGS = set("nav footer aside form menu dialog button select noscript template svg iframe object canvas audio video".split())
FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising advertorial banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription sidebar widget widgets related recommended recommendations share sharing "
    "social comment comments reply replies respond discussion disqus nav navbar navigation menu breadcrumb breadcrumbs footer foot header masthead topbar "
    "pagination pager login signup register search toolbar skip complementary contentinfo paywall".split()
)
# Of these, words of texts that are never the page's own, and words of the page's frame, which may be put on what holds the article.
OTHERS = set("ad ads adv advert adverts advertisement advertising advertorial sponsored related recommended recommendations comment comments reply replies respond discussion disqus".split())
FRAME = set("sidebar nav navbar navigation menu footer foot header masthead topbar toolbar banner breadcrumb breadcrumbs pagination pager search login widget widgets".split())
# Words behind which a name says what it is: comments-list is comments, comments-off is not, nor is social-science.
PLACE = set(
    "area bar block blocks body bottom box button buttons cell col column content count desktop fixed form global group header heading holder icon icons inner item items "
    "label left line link links list main mobile module outer page panel primary right row secondary section sections site sticky tag text title top unit wrap wrapper".split()
)
# Parts of class names that tell of a layout, and ends of names of what holds content and furniture.
LAYOUT, WRAP = set("has have with without no layout".split()), set("wrap wrapper container grid row".split())
CONTENT = set("article content entry post story main maintext bodytext articlebody".split())
BLOCK_TAGS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script|style|textarea|title|xmp"

_MARK = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW_TAGS})\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ID = re.compile(r"""\bid\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HREF = re.compile(r"\bhref\s*=", re.I)

# What an element says of its text: furniture whatever it holds; furniture but for an article or main element; furniture but for any
# content inside; nothing; content by its class; an article or main element.
NEVER, UNLESS_ARTICLE, UNLESS_CONTENT, NOTHING, CONTENT_CLASS, ARTICLE = -3, -2, -1, 0, 1, 2


def _head(parts: list[str]) -> set[str]:
    """The words of a class name if it names furniture, else none: what stands before words of place must be furniture."""
    end = len(parts)
    while end > 1 and parts[end - 1] in PLACE and not parts[end - 1] in FURNITURE - {"header"}:
        end -= 1
    return set(parts) if parts and parts[end - 1] in FURNITURE else set(parts) - FURNITURE


def _wrapper(parts: set[str]) -> bool:
    """Whether the parts of one class name are a layout's, such as has-sidebar or content-sidebar-wrap."""
    return bool(parts & LAYOUT or parts & WRAP and parts & CONTENT)


def _zone(tag: str, attrs: str, inside: bool) -> int:
    """What an element says of its text; ``inside`` content, a header is the article's own."""
    if tag == "form":
        return NEVER if attrs and _HIDDEN.search(attrs) else UNLESS_CONTENT
    if tag in FURNITURE_TAGS or attrs and _HIDDEN.search(attrs):
        return NEVER
    if tag == "header" and not inside:
        return UNLESS_ARTICLE
    if tag == "main":
        return ARTICLE
    if not attrs or tag in ("html", "body"):
        return ARTICLE if tag == "article" else NOTHING
    # A section's id is its heading's, not a kind of section.
    said = attrs if tag != "section" or not inside else _ID.sub(" ", attrs)
    whole = [_head([n.lower() for n in _PART.findall(name)]) for found in _NAMES.findall(said) for name in "".join(found).split()]
    if tag == "article":
        return NEVER if any(name and name & FURNITURE and name <= OTHERS for name in whole) else ARTICLE
    names = set().union(*(name for name in whole if not _wrapper(name)))
    if names & FURNITURE and not (inside and names & FURNITURE <= {"header", "main", "content"}):
        return NEVER if names & OTHERS else UNLESS_CONTENT if names & FURNITURE <= FRAME else UNLESS_ARTICLE
    return CONTENT_CLASS if set().union(*whole) & CONTENT else NOTHING


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, words in links, zone) of the text blocks of a page, in order; empty ones are left out."""
    out: list[tuple[str, int, int, int]] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, int]] = []
    anchors = 0
    opened = 0  # elements around the open anchor
    paragraph = linked_paragraph = False  # in a p element, and the anchor began there
    zone = 0

    def flush():
        nonlocal parts, links
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            linked = len(entities.unescape("".join(links)).split()) if links else 0
            out.append((text, text.count(" ") + 1, linked, zone))
        parts, links = [], []

    def add(text: str):
        parts.append(text)
        if anchors:
            links.append(text)

    def leave(count: int):
        nonlocal zone, anchors
        del stack[count:]
        if count < opened:
            anchors = 0  # an anchor ends with the element it began in
        zone = _sum(stack)

    at = 0
    for m in _MARK.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"]:
                flush() if m["raw"].lower() in ("textarea", "title") else None
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if tag in BLOCK_TAGS:
            flush()
            if paragraph and linked_paragraph:
                anchors = 0
            paragraph, linked_paragraph = tag == "p" and not (m["end"] or m["end2"]), False
        elif tag == "br":
            add(" ")
            continue
        if m["end"] or m["end2"]:
            if tag == "a":
                anchors = max(0, anchors - 1)
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if stack[i][1]:
                        flush()
                    leave(i)
                    break
            continue
        if tag == "a":
            anchors = 1 if _HREF.search(attrs) else 0  # links do not nest
            opened, linked_paragraph = len(stack), paragraph
            continue
        if tag in VOID_TAGS or attrs.rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in BLOCK_TAGS and stack and stack[-1][0] == "p":
            leave(len(stack) - 1)  # a block ends a paragraph
        said = _zone(tag, attrs, zone > 0)
        if said or tag in BLOCK_TAGS and tag != "p":
            if said:
                flush()
            stack.append((tag, said))
            zone = _sum(stack)
    add(page[at:])
    flush()
    return out


def _sum(stack: list[tuple[str, int]]) -> int:
    """-1 in furniture, 1 in content, 0 unknown: the innermost element that may say so."""
    zone = NOTHING
    for _, said in stack:
        if said == NEVER:
            return -1
        if said < 0:
            zone = min(zone, said)
        elif said and (zone >= UNLESS_CONTENT or said == ARTICLE):
            zone = said
    return (zone > 0) - (zone < 0)


def features(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Words and link density of each block, of the one before and of the one after, and the zone; what is outside is no neighbour of content."""
    words = np.array([0, *[b[1] for b in found], 0], float)
    density = np.array([0, *[b[2] / b[1] for b in found], 0], float)
    zone = np.array([b[3] for b in found], float)
    around = np.array([0, *zone, 0])
    before, after = ((zone <= 0) | (side > 0) for side in (around[:-2], around[2:]))
    return np.stack([words[1:-1], density[1:-1], words[:-2] * before, density[:-2] * before, words[2:] * after, density[2:] * after, zone], axis=1)


def grow(rows: np.ndarray, labels: np.ndarray):
    """A decision tree by the least Gini impurity, grown until its leaves are pure: a label, or (feature, cut, lower, upper)."""
    if len(set(labels.tolist())) == 1:
        return int(labels[0])
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= cut
            impurity = sum(len(y) * (y.mean() * (1 - y.mean())) for y in (labels[low], labels[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(cut), low)
    if best is None:  # equal rows of different labels
        return int(labels.mean() >= 0.5)
    _, feature, cut, low = best
    return feature, cut, grow(rows[low], labels[low]), grow(rows[~low], labels[~low])


def tree(table=LABELLED):
    data = np.array(table, float)
    return grow(data[:, :-1], data[:, -1])


def decide(node, rows: np.ndarray) -> np.ndarray:
    if isinstance(node, int):
        return np.full(len(rows), node == 1)
    feature, cut, lower, upper = node
    low = rows[:, feature] <= cut
    out = np.empty(len(rows), bool)
    out[low], out[~low] = decide(lower, rows[low]), decide(upper, rows[~low])
    return out


def main_text(page: str, node) -> str:
    """The blocks the tree keeps, in page order, with an empty line between them."""
    found = blocks(page)
    if not found:
        return ""
    kept = decide(node, features(found))
    return "\n\n".join(b[0] for b, keep in zip(found, kept) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty html has an empty text; null ids and urls stay null; equal
    pages give equal texts; an empty table gives no rows.  Pages of any length
    go through whole.
    """
    node = tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(page, node) if page else "" for page in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
