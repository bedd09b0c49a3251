"""Main text of HTML pages from shallow block features and a small decision tree.

A page is cut, in one pass over its markup, into flat text blocks (a block ends where a
block-level tag starts or ends).  Each block has its word count and link density, those
of the blocks before and after, the element it fills (heading, paragraph, list item or
another) and one flag: whether an element around it is named as something other than
text (``nav``, ``class="ad"``).  Where the article stands in the markup is not asked.  A
decision tree, grown here by Gini impurity on the labelled table below, tells article
text from the rest.  Kept blocks are joined in page order by newlines.

The pass takes time in proportion to the page, however its tags nest or stay open.

Defined cases: null or empty html gives empty text; character references are decoded
inside text; runs of white space inside a block become one space; ``<br>`` is white
space; an unclosed comment, script or style runs to the page's end; an unclosed
container ends with the one around it; an end tag without a start is passed over;
repeated rows are handled alike; an empty table gives an empty result; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, and words that name kinds of containers.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template iframe object svg math canvas textarea audio video noframes noembed xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS = frozenset("article main".split())
ITEMS = frozenset("li dt dd td th".split())
PAGE_TAGS = frozenset("nav aside footer form menu dialog select button fieldset head search".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert warning popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar sidebar sidenav aside rail widget widgets related recommended trending popular "
    "share sharing social follow footer copyright legal masthead topbar newsletter subscribe subscription signup login search form "
    "comment comments commentlist reply replies respond disqus discussion complementary contentinfo".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*)(?:>|\Z)|(?P<text>[^<]+|<+(?=<)|<)",
    re.S,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LETTERS = re.compile("[A-Z]?[a-z]+|[A-Z]+")


OTHER, ITEM, PARAGRAPH, HEADING = range(4)


class Block(NamedTuple):
    """Text, its words, how many of them are links, the element it fills, and whether one around it is named as no text."""

    text: str
    words: int
    linked: int
    element: int
    named: bool


def _named(tag: str, attrs: str, around: tuple[bool, bool]) -> tuple[bool, bool]:
    """Whether an element or one around it is named as no text, and whether an article is around."""
    named, article = around
    if named or tag in PAGE_TAGS or (tag == "header" and not article):
        return True, article
    if attrs and tag not in ("body", "html"):
        for m in NAMED.finditer(attrs):
            if any(x.lower() in BOILER_WORDS for x in LETTERS.findall(m[1] or m[2] or m[3] or "")):
                return True, article
    return False, article or tag in ARTICLE_TAGS


class Page:
    """The pass over one page."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.found: list[Block] = []
        self.stack: list[tuple[str, tuple[bool, bool]]] = []  # open elements, and what holds within them
        self.open: Counter[str] = Counter()
        self.unclosed: set[str] = set()  # tags whose end does not come any more
        self.parts: list[str] = []
        self.linked, self.anchor = 0, False

    def push(self, tag: str, attrs: str) -> None:
        self.stack.append((tag, _named(tag, attrs, self.stack[-1][1] if self.stack else (False, False))))
        self.open[tag] += 1

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        return tag

    def end_block(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                tag, (named, _) = self.stack[-1] if self.stack else ("", (False, False))
                element = HEADING if tag in HEADINGS else PARAGRAPH if tag == "p" else ITEM if tag in ITEMS else OTHER
                self.found.append(Block(" ".join(words), len(words), min(self.linked, len(words)), element, named))
            self.parts.clear()
        self.linked = 0

    def skip(self, tag: str, to_end: bool) -> None:
        """Moves behind the tag's end; where there is none, to the page's end or not at all."""
        gone = None if tag in self.unclosed else re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(self.page, self.at)
        if gone:
            self.at = gone.end()
        else:
            self.unclosed.add(tag)
            self.at = len(self.page) if to_end else self.at

    def block_tag(self, tag: str, end: bool, attrs: str) -> None:
        self.end_block()
        self.anchor = False
        if tag == "hr":
            return
        while self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] in HEADINGS):
            self.pop()  # paragraphs and headings hold no blocks
        if end:
            if self.open[tag] > 0:
                while self.pop() != tag:
                    pass
        elif not attrs.endswith("/"):
            if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and self.stack and self.stack[-1][0] == tag:
                self.pop()
            self.push(tag, attrs)

    def read(self) -> list[Block]:
        while self.at < len(self.page):
            m = TOKEN.match(self.page, self.at)
            self.at = m.end()
            text, tag = m["text"], m["tag"]
            if text is not None:
                text = entities.unescape(text) if "&" in text else text
                self.parts.append(text)
                if self.anchor:
                    self.linked += len(text.split())
                continue
            if tag is None:
                continue
            tag, end = tag.lower(), bool(m["end"])
            if tag in RAW_TAGS and not end:
                if not m["attrs"].endswith("/"):
                    self.skip(tag, True)
            elif tag == "a":
                self.anchor = not end
            elif tag == "br":
                self.parts.append(" ")
            elif tag == "button" and not end:
                self.skip(tag, False)
            elif tag in BLOCK_TAGS or "-" in tag:
                self.block_tag(tag, end, m["attrs"])
        self.end_block()
        return self.found


def blocks(page: str) -> list[Block]:
    """The page's text blocks, in order."""
    return Page(page).read()


def features(page: list[Block]) -> list[list[float]]:
    """For each block: words and link density of it and its neighbours, element, name."""
    size = [0, *(b.words for b in page), 0]
    link = [0.0, *(b.linked / b.words for b in page), 0.0]
    return [
        [size[i], link[i], size[i - 1], link[i - 1], size[i + 1], link[i + 1], float(b.element), float(b.named)]
        for i, b in enumerate(page, 1)
    ]


#: The labelled table: pages as lines of blocks (element, words, linked words, named, main text).
#: h: heading, p: paragraph, l: list item or table cell, o: another element.
LABELLED = """
l 2 2 1 0 | l 1 1 1 0 | o 12 0 1 0 | h 7 0 0 1 | p 7 0 0 1 | p 64 0 0 1 | p 1 0 0 1 | p 120 2 0 1 | p 3 0 0 1 | o 9 0 1 0
l 1 1 0 0 | l 3 3 0 0 | l 2 2 0 0 | o 4 0 0 0 | h 1 0 0 1 | p 1 0 0 1 | p 2 0 0 1 | o 30 3 1 0
l 5 5 0 0 | l 1 1 0 0 | h 6 0 0 1 | p 48 0 0 1 | p 95 3 0 1 | p 7 0 0 1 | p 60 0 0 1 | p 8 8 0 0 | l 4 4 0 0 | o 11 2 0 0
o 3 3 0 0 | o 2 2 0 0 | o 4 4 0 0 | h 8 0 0 1 | p 80 1 0 1 | p 35 0 0 1 | h 2 0 0 0 | l 5 5 0 0 | l 6 6 0 0 | l 3 3 0 0
l 1 1 0 0 | l 2 2 0 0 | l 1 1 0 0 | o 13 0 0 0 | h 9 0 0 1 | p 41 0 0 1 | p 33 6 0 1 | p 54 0 0 1 | o 5 2 0 0 | o 2 2 0 0
o 55 0 1 0 | p 70 1 1 0 | h 10 0 0 1 | p 88 5 0 1 | p 6 6 0 1 | p 44 0 0 1 | p 62 0 1 0 | p 28 0 1 0 | l 5 5 1 0
h 5 0 0 1 | l 20 0 0 1 | l 12 0 0 1 | l 9 1 0 1 | p 30 0 0 1 | l 2 2 0 0 | l 3 3 0 0 | p 90 0 1 0
o 14 0 1 0 | o 150 0 0 1 | o 130 4 0 1 | o 2 0 0 1 | o 99 0 0 1 | o 20 0 0 0
l 10 10 0 0 | l 7 7 0 0 | l 6 5 0 0 | h 5 0 0 1 | p 26 0 0 1 | h 1 0 0 0 | l 4 4 0 0 | l 9 9 0 0
o 2 0 0 0 | o 3 3 0 0 | o 4 0 0 0 | l 5 5 0 0 | h 20 0 0 1 | p 4 0 0 1 | p 70 0 0 1 | p 3 0 0 1 | p 55 0 0 1 | o 3 0 0 0 | l 4 4 0 0 | o 2 0 0 0
h 6 0 0 1 | p 60 0 0 1 | p 3 0 0 1 | p 72 1 0 1 | h 2 0 0 0 | l 6 6 0 0 | l 5 5 0 0 | l 7 7 0 0 | l 4 4 0 0 | o 3 3 0 0 | o 2 2 0 0
l 4 4 0 0 | h 2 0 0 1 | p 1 0 0 1 | p 2 0 0 1 | p 3 0 0 1 | l 5 5 0 0 | l 2 2 0 0
l 1 1 0 0 | l 1 1 0 0 | o 7 0 1 0 | h 11 0 0 1 | p 95 0 0 1 | p 2 0 0 1 | p 6 0 0 1 | o 12 0 1 0
l 1 1 0 0 | l 1 1 0 0 | o 17 0 0 0 | h 12 0 0 1 | p 130 0 0 1 | p 40 0 0 1 | o 16 0 0 0
l 1 1 0 0 | o 8 0 0 0 | h 10 0 0 1 | p 33 0 0 1 | o 9 0 0 0
p 3 3 0 0 | h 4 0 0 1 | p 36 0 0 1 | l 1 0 0 1 | l 4 0 0 1 | l 2 0 0 1 | p 40 0 0 1 | p 30 0 1 0 | p 2 2 0 0
o 4 4 0 0 | h 2 0 0 1 | p 25 0 0 1 | h 2 0 0 1 | p 28 0 0 1 | p 3 3 0 0 | o 2 0 0 0 | o 4 4 0 0 | o 3 0 0 0
o 3 0 0 0 | o 6 6 0 0 | o 1 0 0 0 | o 3 3 0 0 | h 1 0 0 1 | o 30 0 0 1 | o 40 0 0 1 | o 22 0 0 1 | l 3 3 0 0
h 8 0 0 1 | p 45 5 0 1 | p 40 0 0 1 | p 9 9 0 0 | p 6 6 0 0 | p 8 8 0 0
h 3 0 1 0 | p 44 0 1 0 | h 4 0 0 1 | p 15 0 0 1 | p 3 3 0 1 | p 12 0 0 1 | h 2 0 0 1 | p 77 0 0 1 | h 4 0 1 0 | p 33 0 1 0
h 6 0 0 1 | p 21 0 0 1 | h 3 0 0 1 | l 1 0 0 1 | l 2 0 0 1 | l 1 0 0 1 | p 66 0 0 1 | h 3 0 1 0 | p 8 0 1 0 | p 19 0 1 0 | p 52 0 1 0
h 2 0 0 1 | p 39 0 0 1 | p 17 0 1 0 | p 1 0 0 1 | p 2 2 0 0
l 4 4 0 0 | h 5 0 0 1 | p 36 0 0 1 | p 2 0 0 1 | l 3 3 0 0 | l 2 2 0 0 | h 1 0 0 0 | l 6 6 0 0
h 4 0 0 1 | p 22 0 0 1 | p 58 0 0 1 | p 1 0 0 1 | p 4 4 0 0 | h 2 0 0 0 | p 5 5 0 0
l 1 1 1 0 | l 1 1 1 0 | l 2 2 1 0 | h 7 0 0 1 | p 1 0 0 1 | p 3 0 0 1 | p 2 0 0 1 | p 1 0 0 1 | o 6 0 1 0
"""


class Tree(NamedTuple):
    """A split (feature, threshold, subtree at or below, subtree above), or a leaf's verdict."""

    feature: int
    cut: float
    low: Tree | bool
    high: Tree | bool


def grow(rows: list[list[float]], labels: list[bool], depth: int = 6, least: int = 2) -> Tree | bool:
    """A binary decision tree by Gini impurity; ties go to the first feature and cut."""
    yes = sum(labels)
    if depth == 0 or yes in (0, len(labels)):
        return yes * 2 > len(labels)
    best = None
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            side = [y for r, y in zip(rows, labels, strict=True) if r[f] <= cut]
            n, k = len(side), sum(side)
            m = len(labels) - n
            if min(n, m) < least:
                continue
            impurity = 2 * k * (n - k) / n + 2 * (yes - k) * (m - yes + k) / m
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut
    if best is None:
        return yes * 2 > len(labels)
    _, f, cut = best
    low = [(r, y) for r, y in zip(rows, labels, strict=True) if r[f] <= cut]
    high = [(r, y) for r, y in zip(rows, labels, strict=True) if r[f] > cut]
    return Tree(f, cut, grow(*map(list, zip(*low, strict=True)), depth - 1, least), grow(*map(list, zip(*high, strict=True)), depth - 1, least))


@lru_cache(1)
def tree() -> Tree | bool:
    """The tree grown on the labelled table."""
    rows, labels = [], []
    for line in LABELLED.strip().splitlines():
        cells = [c.split() for c in line.split("|")]
        rows += features([Block("", int(words), int(linked), "olph".index(e), named == "1") for e, words, linked, named, _ in cells])
        labels += [y == "1" for *_, y in cells]
    return grow(rows, labels)


def is_main(row: list[float], at: Tree | bool) -> bool:
    while isinstance(at, Tree):
        at = at.low if row[at.feature] <= at.cut else at.high
    return at


def main_text(page: str | None) -> str:
    """The page's article text."""
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if is_main(row, tree()))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x.as_py()) for x in batch.column("html")]
        names = ["page_id", "url", "text", "n_chars"]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; no shuffle, one page at a time."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
