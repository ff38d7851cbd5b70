"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks: runs of text between block-level tags. Each block has its word count and
link density, those of its two neighbours, whether it is a heading, and two hints from its open tags: whether they stand
inside an article, and whether one of them (by its tag, or by a word of its class, id or role) is a container of menus,
notices, adverts, forms, comments and the like, whose running text no count of words tells from an article's. A decision
tree decides which blocks are main text. It is grown here, by Gini impurity, on a small table of the labelled blocks of
typical pages, marked up well, badly or not at all; a leaf's label is the one most of its rows have. Inside an
article link lists go and links amid running text stay; on pages without hints the counts alone decide.

Blocks that stay are joined by a line feed in page order. Inside a block, character references are decoded and runs of
white space become one space; <br> counts as white space. Nothing else is dropped or cut.

Defined cases: a null or empty page, and a page without main text, give an empty text. Markup that is never closed runs
to the end of its parent, or of the page; `<` that starts no tag is text. Scripts, styles, comments and the head are no
text. Null ids and URLs are kept, repeated rows are extracted each for itself, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th"
    " thead tr ul".split()
)
VOID_TAGS = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: What stands inside is text for no reader.
RAW_TAGS = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
SILENT_TAGS = frozenset("head svg math canvas object template select datalist audio video map".split())
ASIDE_TAGS = frozenset("nav header footer aside form menu button dialog fieldset label option search".split())
MAIN_TAGS = frozenset(["article", "main"])
#: Words of a class, id or role that mark a container of something beside the main text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner banners breadcrumb breadcrumbs byline comment comments commentlist"
    " complementary consent contentinfo cookie cookies copyright dialog discussion disqus dropdown footer form gdpr header login masthead"
    " menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion"
    " recommended related reply replies respond rail search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe"
    " subscription tags teaser toc toolbar topbar widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "aside", "heading"]

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    words: int
    links: float
    in_main: bool
    aside: bool
    heading: bool


@lru_cache(4096)
def _attributes(text: str) -> tuple[bool, bool]:
    """Whether a tag's attributes mark it as beside the main text, or as the main text."""
    aside = main = False
    for m in _ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            aside = True
        elif name in ("class", "id", "role"):
            words = set(_WORDS.findall(_CAMEL.sub(" ", value).lower()))
            aside |= bool(words & ASIDE_WORDS)
            main |= bool(words & MAIN_WORDS)
    return aside, main and not aside


def _close_raw(html: str, name: str, at: int) -> int:
    """The place of </name that ends a raw element, or the page's end."""
    m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
    return m.start() if m else len(html)


def blocks(html: str) -> list[Block]:
    """The flat text blocks of a page, empty ones left out."""
    out: list[Block] = []
    # an open element: tag, (silent, aside, in main, in comments) of all up to it
    stack: list[tuple[str, bool, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    heading = False
    links = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            words = unescape("".join(parts)).split()
            if words:
                n = len(unescape("".join(linked)).split()) if linked else 0
                _, _, aside, main = stack[-1] if stack else ("", False, False, False)
                out.append(Block(" ".join(words), len(words), min(1.0, n / len(words)), main, aside, heading))
            parts, linked = [], []

    def say(text: str) -> None:
        if text and not (stack and stack[-1][1]):
            parts.append(text)
            if links:
                linked.append(text)

    at, end = 0, len(html)
    while at < end:
        i = html.find("<", at)
        if i < 0:
            say(html[at:])
            break
        if i > at:
            say(html[at:i])
        after = html[i + 1 : i + 2]
        if after == "!" or after == "?":
            if html.startswith("<!--", i):
                j = html.find("-->", i + 2)
                at = end if j < 0 else j + 3
            else:
                j = html.find(">", i)
                at = end if j < 0 else j + 1
            continue
        m = _TAG.match(html, i) or _LOOSE_TAG.match(html, i)
        if not m:
            if after == "/" or after.isalpha():
                j = html.find(">", i)
                at = end if j < 0 else j + 1  # a broken tag
            else:
                say("<")
                at = i + 1
            continue
        closing, tag, rest = m[1], m[2].lower(), m[3]
        at = m.end()
        block = tag in BLOCK_TAGS
        if block:
            flush()
            heading = False
        if tag == "br":
            say(" ")
        elif closing:
            if any(x[0] == tag for x in stack):
                while (gone := stack.pop())[0] != tag:
                    links -= gone[0] == "a"
                links -= tag == "a"
        elif tag in RAW_TAGS:
            if not rest.endswith("/") or tag in ("script", "style"):
                at = _close_raw(html, tag, at)
        elif tag not in VOID_TAGS and not rest.endswith("/"):
            _, silent, aside, main = stack[-1] if stack else ("", False, False, False)
            if tag == "p" and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
                stack.pop()
                _, silent, aside, main = stack[-1] if stack else ("", False, False, False)
            if tag == "body":
                silent = False
            marked, named = _attributes(rest) if rest else (False, False)
            if tag in MAIN_TAGS and not marked:
                # an article opens anew, unless it stands among comments or the like
                aside, main = aside and any(x[0] in ("section", "div", "aside", "article") for x in stack if x[2]), True
            else:
                aside = aside or marked or tag in ASIDE_TAGS
                main = main or named
            stack.append((tag, silent or tag in SILENT_TAGS, aside, main))
            links += tag == "a"
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = True
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES per block; beyond either end of the page stands an empty block."""
    words = np.array([0, *(b.words for b in found), 0], float)
    links = np.array([0, *(b.links for b in found), 0], float)
    flags = np.array([(b.in_main, b.aside, b.heading) for b in found], float).reshape(-1, 3)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], flags])


#: The labelled blocks of typical pages, in page order: words, link density, hints (a: in an article, x: in
#: a container beside the main text, h: a heading) and whether the block is main text.
PAGES = [
    # an article marked up as such, between menu, advert and footer
    [(1, 1.0, "x", 0)] * 4 + [(7, 0.0, "x", 0), (9, 0.0, "ah", 1), (60, 0.0, "a", 1), (45, 0.05, "a", 1), (5, 0.0, "a", 1), (30, 0.1, "a", 1), (9, 0.3, "x", 0)],
    # a short one, and one of a single word
    [(2, 1.0, "x", 0)] * 3 + [(6, 0.0, "ah", 1), (12, 0.0, "a", 1), (4, 0.0, "x", 0)],
    [(1, 1.0, "x", 0), (1, 1.0, "x", 0), (1, 0.0, "ah", 1), (1, 0.0, "a", 1), (3, 0.0, "x", 0)],
    [(1, 1.0, "x", 0), (8, 0.0, "x", 0), (2, 0.0, "a", 1), (6, 0.0, "x", 0)],
    [(10, 0.0, "ah", 1), (3, 0.0, "a", 1)],
    [(4, 0.0, "a", 1)],
    # links follow a short last paragraph, or stand before a short first one
    [(7, 0.0, "ah", 1), (66, 0.0, "a", 1), (4, 0.0, "a", 1), (2, 1.0, "x", 0), (3, 1.0, "x", 0), (1, 1.0, "x", 0)],
    [(2, 1.0, "x", 0), (3, 0.0, "a", 1), (11, 0.0, "a", 1), (2, 1.0, "x", 0), (2, 1.0, "", 0)],
    [(2, 1.0, "", 0), (5, 0.0, "a", 1), (2, 0.0, "a", 1), (14, 1.0, "", 0), (3, 0.0, "", 0)],
    [(1, 1.0, "x", 0), (6, 0.0, "a", 1), (1, 1.0, "x", 0), (2, 1.0, "x", 0)],
    [(1, 1.0, "x", 0), (4, 0.0, "ah", 1), (2, 1.0, "x", 0), (1, 1.0, "", 0)],
    [(24, 0.0, "a", 1), (3, 0.0, "ah", 1), (40, 0.6, "a", 1), (5, 0.0, "ah", 1), (2, 1.0, "x", 0)],
    [(3, 0.0, "a", 1), (2, 1.0, "x", 0)],
    [(30, 0.0, "x", 0), (6, 0.0, "ah", 1), (4, 1.0, "a", 1), (44, 0.0, "a", 1)],
    [(12, 1.0, "", 0), (2, 0.0, "a", 1), (3, 1.0, "", 0), (5, 0.0, "", 0), (2, 1.0, "", 0)],
    [(1, 1.0, "", 0), (30, 0.0, "a", 1), (6, 1.0, "", 0), (2, 0.0, "h", 0), (4, 1.0, "", 0)],
    # an article with a link amid its text, tags and further reading at its end
    [(2, 1.0, "x", 0), (8, 0.0, "ah", 1), (70, 0.0, "a", 1), (3, 1.0, "a", 1), (50, 0.2, "a", 1), (5, 1.0, "a", 0), (6, 1.0, "a", 0), (4, 1.0, "a", 0), (3, 0.0, "x", 0)],
    [(9, 0.0, "ah", 1), (40, 0.0, "a", 1), (6, 0.9, "a", 1), (35, 0.0, "a", 1), (2, 1.0, "a", 0), (2, 1.0, "a", 0), (2, 1.0, "a", 0), (20, 0.5, "x", 0)],
    # a menu inside the article, at its top
    [(1, 1.0, "a", 0), (2, 1.0, "a", 0), (1, 1.0, "a", 0), (7, 0.0, "ah", 1), (55, 0.0, "a", 1), (25, 0.3, "a", 1)],
    # share line, form and comments inside the article
    [(8, 0.0, "ah", 1), (90, 0.0, "a", 1), (3, 1.0, "ax", 0), (2, 0.0, "ax", 0), (40, 0.0, "ax", 0), (15, 0.0, "ax", 0), (65, 0.05, "ax", 0), (2, 0.5, "ax", 0)],
    # an advert and a notice amid the text
    [(30, 0.05, "x", 0), (7, 0.0, "ah", 1), (48, 0.0, "a", 1), (12, 0.0, "ax", 0), (52, 0.0, "a", 1), (9, 0.4, "ax", 0), (33, 0.0, "a", 1), (25, 0.1, "x", 0)],
    # a list and a table inside an article
    [(6, 0.0, "ah", 1), (20, 0.0, "a", 1), (4, 0.0, "a", 1), (3, 0.0, "a", 1), (1, 0.0, "a", 1), (2, 0.0, "a", 1), (5, 0.4, "a", 1), (18, 0.0, "a", 1)],
    # sidebars with running text
    [(60, 0.0, "x", 0), (35, 0.2, "x", 0), (10, 0.0, "ah", 1), (100, 0.02, "a", 1), (75, 0.0, "a", 1), (45, 0.0, "x", 0), (5, 1.0, "x", 0)],
    # only containers beside the main text are marked
    [(1, 1.0, "x", 0)] * 3 + [(8, 0.0, "h", 1), (70, 0.0, "", 1), (25, 0.1, "", 1), (4, 0.0, "", 1), (50, 0.0, "", 1), (12, 0.2, "x", 0)],
    [(5, 0.6, "x", 0), (6, 0.0, "h", 1), (28, 0.0, "", 1), (22, 0.0, "", 1), (3, 0.0, "h", 1), (40, 0.1, "", 1), (20, 0.0, "x", 0)],
    # nothing is marked: menus, teasers and a line of copyright among links
    [(1, 1.0, "", 0), (2, 1.0, "", 0), (2, 1.0, "", 0), (7, 0.0, "h", 1), (80, 0.0, "", 1), (40, 0.1, "", 1), (3, 0.0, "", 1), (55, 0.0, "", 1), (2, 0.0, "h", 0), (8, 1.0, "", 0), (7, 1.0, "", 0), (6, 0.0, "", 0)],
    [(4, 0.0, "", 0), (3, 1.0, "", 0), (2, 1.0, "", 0), (50, 0.0, "", 1), (35, 0.0, "", 1), (90, 0.05, "", 1), (9, 0.8, "", 0), (5, 1.0, "", 0), (4, 0.0, "", 0)],
    [(2, 0.5, "", 0), (6, 1.0, "", 0), (9, 0.0, "h", 1), (24, 0.0, "", 1), (30, 0.0, "", 1), (28, 0.05, "", 1), (2, 1.0, "", 0), (3, 1.0, "", 0)],
    [(6, 1.0, "", 0), (50, 0.0, "", 1), (50, 0.0, "", 1), (3, 1.0, "", 0)],
    # a portal: short lines between links
    [(2, 1.0, "", 0), (5, 0.0, "", 0), (3, 1.0, "", 0), (9, 0.0, "", 0), (4, 1.0, "", 0), (2, 0.0, "h", 0), (8, 1.0, "", 0), (6, 0.0, "", 0), (30, 0.8, "", 0)],
    [(12, 1.0, "", 0), (3, 0.0, "", 0), (12, 1.0, "", 0), (14, 0.6, "", 0), (2, 0.0, "", 0), (1, 1.0, "", 0)],
    # a plain text page, and one of a single paragraph
    [(5, 0.0, "h", 1), (120, 0.0, "", 1), (8, 0.0, "", 1), (60, 0.0, "", 1)],
    [(25, 0.0, "", 1)],
]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """The features of all blocks of PAGES, with their labels."""
    rows, labels = [], []
    for page in PAGES:
        rows.append(features([Block("", words, links, "a" in hints, "x" in hints, "h" in hints) for words, links, hints, _ in page]))
        labels += [label for *_, label in page]
    return np.concatenate(rows), np.array(labels)


Node = tuple  # (label,) or (feature, threshold, below, above)


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """The split with the least Gini impurity, again and again, until a node has one label or no split helps."""
    label = int(2 * y.sum() > len(y))
    if not depth or y.min() == y.max():
        return (label,)
    best, choice = 2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None
    for f in range(x.shape[1]):
        for cut in (np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2:
            low = x[:, f] <= cut
            score = sum(2 * part.mean() * (1 - part.mean()) * len(part) for part in (y[low], y[~low]))
            if score < best:
                best, choice = score, (f, float(cut))
    if choice is None:
        return (label,)
    f, cut = choice
    low = x[:, f] <= cut
    return (f, cut, grow_tree(x[low], y[low], depth - 1), grow_tree(x[~low], y[~low], depth - 1))


def classify(tree: Node, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(node) == 1:
            out[rows] = bool(node[0])
        elif len(rows):
            low = x[rows, node[0]] <= node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def main_text(html: str | None, tree: Node) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, classify(tree, features(found)), strict=True) if keep)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the html column, with text and n_chars (which replace columns of these names)."""
    tree = grow_tree(*labelled_table())

    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, tree) for h in column], dtype=object)

    kept = [F.col(c) for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    return pages.select(*kept, extract(F.col(html)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
