"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once from left to right into text blocks, cut at block-level
tags. Each block gets its word count and link density, those of its two
neighbours, whether it is a heading, whether it stands within an article or
main element, and how strongly the elements around it are named as boilerplate
(1 for tags, roles and hidden ones; less for classes and ids, least where the
name holds other words too). A decision tree grown on the small table LABELLED
below keeps or drops it: names alone do not decide, long running text under a
weak name stays, and short linked blocks among others like them go even in an
article.

Tags are read as browsers do: a value without quotes ends at white space or
``>``, a tag or comment that never ends takes the rest of the page, raw text
ends at its own end tag. The time is proportional to the page, whatever it
holds, and memory to the page as well. Null or empty pages give an empty text;
repeated pages give repeated rows; an empty table gives an empty table; other
columns are dropped.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .batches import by_bytes
from .tree import Node, grow, predict

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title".split())
SKIP = RAW | frozenset("noscript template svg math head select iframe object canvas audio video button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one of the same kind, unless an element of SCOPE was opened since.
SELF_ENDING = frozenset("p li td th tr dt dd".split())
SCOPE = frozenset("ul ol table div section article body main aside nav form blockquote dl".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of classes and ids that hardly ever name main text, and words that also do.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer comments commentlist replies respond disqus feedback share sharing social newsletter subscribe subscription signup login popup modal widget widgets pager pagination teaser".split())
WEAK = frozenset("comment reply discussion related recommended recommendations legal copyright disclaimer notice notices alert announcement header foot side search form toolbar overlay".split())
#: After these a word says what the element holds or lacks, not what it is.
NOT_ITSELF = frozenset("has no with without".split())
MAIN_WORDS = frozenset("article content entry post story main body".split())

_plain_tag = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)\s*>")
_name = re.compile(r"[a-zA-Z][^\s/>]*")
_attr = re.compile(r"[\s/]*([^\s/>=]+|=[^\s/>=]*)(?:\s*=\s*)?")
_space = re.compile(r"[\s/]*")
_bare = re.compile(r"[^\s>]*")
_words = re.compile(r"[a-z]+")
_camel = re.compile(r"([a-z])([A-Z])")
_hides = re.compile(r"display\s*:\s*none", re.I)

FEATURES = ("boiler", "inside", "heading", "words", "links", "prev_words", "prev_links", "next_words", "next_links")

#: (boiler, inside, heading, words, links, prev words, prev links, next words, next links): main text or not.
LABELLED = [
    # menus and link lists, also within articles
    ((1, 0, 0, 1, 1.0, 0, 0.0, 1, 1.0), 0), ((1, 0, 0, 1, 1.0, 1, 1.0, 1, 1.0), 0), ((1, 0, 0, 3, 1.0, 1, 1.0, 6, 0.0), 0),
    ((0, 0, 0, 1, 1.0, 1, 1.0, 1, 1.0), 0), ((0, 0, 0, 2, 1.0, 3, 1.0, 2, 1.0), 0), ((0, 0, 0, 4, 0.9, 2, 1.0, 5, 1.0), 0),
    ((0, 0, 0, 6, 0.8, 1, 1.0, 40, 0.0), 0), ((0, 0, 0, 12, 0.9, 60, 0.0, 3, 1.0), 0), ((0, 0, 0, 30, 0.7, 4, 1.0, 8, 0.9), 0),
    ((0, 1, 0, 1, 1.0, 40, 0.0, 1, 1.0), 0), ((0, 1, 0, 1, 1.0, 1, 1.0, 1, 1.0), 0), ((0, 1, 0, 1, 1.0, 1, 1.0, 50, 0.0), 0),
    ((0, 1, 0, 2, 1.0, 3, 1.0, 2, 1.0), 0), ((0, 1, 0, 2, 1.0, 30, 0.0, 3, 1.0), 0), ((0, 1, 0, 2, 1.0, 2, 1.0, 20, 0.0), 0),
    # adverts, notices, sidebars, comments, forms by tag, role or a strong name
    ((1, 0, 0, 6, 0.0, 1, 1.0, 7, 0.0), 0), ((1, 0, 0, 40, 0.0, 9, 0.0, 80, 0.0), 0), ((1, 1, 0, 12, 0.0, 60, 0.0, 70, 0.0), 0),
    ((1, 1, 0, 35, 0.1, 90, 0.0, 20, 0.0), 0), ((1, 1, 1, 2, 0.0, 90, 0.0, 20, 0.0), 0), ((1, 0, 1, 3, 0.0, 70, 0.0, 10, 0.5), 0),
    ((1, 1, 0, 3, 1.0, 45, 0.0, 3, 1.0), 0), ((1, 0, 0, 150, 0.0, 20, 0.0, 30, 0.0), 0), ((1, 1, 0, 200, 0.0, 3, 0.0, 15, 0.0), 0),
    ((0.9, 0, 0, 10, 0.0, 2, 0.9, 9, 0.0), 0), ((0.9, 1, 0, 35, 0.0, 50, 0.0, 60, 0.0), 0), ((0.9, 1, 0, 90, 0.0, 2, 0.0, 40, 0.0), 0),
    ((0.9, 1, 1, 1, 0.0, 60, 0.0, 30, 0.0), 0), ((0.9, 0, 0, 120, 0.0, 1, 1.0, 8, 0.0), 0), ((0.9, 1, 0, 6, 0.0, 1, 0.0, 12, 0.0), 0),
    ((0.7, 1, 0, 35, 0.0, 50, 0.0, 28, 0.0), 0), ((0.7, 1, 1, 2, 0.0, 70, 0.0, 30, 0.0), 0), ((0.7, 0, 0, 60, 0.0, 3, 0.0, 4, 0.0), 0),
    ((0.7, 1, 0, 4, 0.0, 2, 0.0, 60, 0.0), 0), ((0.7, 0, 0, 5, 1.0, 60, 0.0, 5, 1.0), 0), ((0.7, 1, 0, 110, 0.0, 40, 0.0, 3, 0.0), 0),
    # weak names: short blocks go, and linked ones, and those outside an article
    ((0.5, 0, 0, 8, 0.0, 1, 1.0, 50, 0.0), 0), ((0.5, 0, 0, 40, 0.0, 3, 0.0, 4, 0.0), 0), ((0.5, 0, 1, 2, 0.0, 60, 0.0, 5, 1.0), 0),
    ((0.5, 1, 0, 4, 0.0, 60, 0.0, 30, 0.0), 0), ((0.5, 1, 0, 7, 0.0, 40, 0.0, 50, 0.0), 0), ((0.5, 1, 0, 5, 1.0, 70, 0.0, 5, 1.0), 0),
    ((0.5, 1, 0, 30, 0.8, 40, 0.0, 25, 0.9), 0), ((0.5, 1, 0, 9, 0.9, 12, 0.0, 40, 0.0), 0), ((0.5, 1, 0, 3, 0.0, 9, 0.0, 4, 0.0), 0),
    ((0.5, 0, 0, 70, 0.0, 30, 0.0, 2, 1.0), 0), ((0.3, 0, 0, 5, 0.0, 2, 1.0, 40, 0.0), 0), ((0.3, 0, 0, 3, 1.0, 4, 1.0, 3, 1.0), 0),
    ((0.3, 1, 0, 4, 1.0, 20, 0.0, 4, 1.0), 0), ((0.3, 1, 0, 3, 1.0, 4, 1.0, 5, 1.0), 0),
    # weak names over running text of an article
    ((0.5, 1, 0, 30, 0.0, 60, 0.0, 40, 0.0), 1), ((0.5, 1, 0, 80, 0.0, 20, 0.0, 50, 0.0), 1), ((0.5, 1, 0, 45, 0.1, 9, 0.0, 70, 0.0), 1),
    ((0.5, 1, 0, 20, 0.0, 70, 0.0, 35, 0.0), 1), ((0.5, 1, 0, 16, 0.0, 40, 0.0, 30, 0.0), 1), ((0.5, 1, 0, 60, 0.0, 40, 0.0, 0, 0.0), 1),
    ((0.3, 1, 1, 2, 0.0, 60, 0.0, 40, 0.0), 1), ((0.3, 1, 0, 6, 0.0, 40, 0.0, 30, 0.0), 1), ((0.3, 1, 0, 50, 0.0, 2, 0.0, 60, 0.0), 1),
    ((0.3, 1, 0, 90, 0.2, 50, 0.0, 3, 0.0), 1), ((0.3, 1, 0, 12, 0.0, 80, 0.0, 20, 0.0), 1),
    # footers and short page furniture
    ((1, 0, 0, 14, 0.0, 80, 0.0, 0, 0.0), 0), ((1, 0, 0, 5, 0.4, 30, 0.0, 0, 0.0), 0), ((0, 0, 0, 4, 0.0, 50, 0.0, 0, 0.0), 0),
    ((0, 0, 0, 2, 0.0, 1, 1.0, 1, 1.0), 0), ((0, 0, 0, 3, 0.5, 12, 0.0, 2, 1.0), 0), ((0, 0, 0, 5, 0.0, 3, 1.0, 2, 1.0), 0),
    # headings and paragraphs of articles
    ((0, 1, 1, 5, 0.0, 7, 0.0, 6, 0.0), 1), ((0, 1, 1, 1, 0.0, 60, 0.0, 40, 0.0), 1), ((0, 1, 1, 9, 1.0, 0, 0.0, 50, 0.0), 1),
    ((0, 1, 0, 1, 0.0, 80, 0.0, 12, 0.0), 1), ((0, 1, 0, 2, 0.0, 1, 0.0, 3, 0.0), 1), ((0, 1, 0, 7, 0.0, 5, 0.0, 40, 0.0), 1),
    ((0, 1, 0, 50, 0.0, 6, 0.0, 70, 0.0), 1), ((0, 1, 0, 120, 0.1, 90, 0.0, 10, 0.0), 1), ((0, 1, 0, 300, 0.0, 0, 0.0, 0, 0.0), 1),
    ((0, 1, 0, 20, 0.3, 40, 0.0, 14, 0.0), 1), ((0, 1, 0, 6, 1.0, 40, 0.0, 30, 0.0), 1), ((0, 1, 0, 15, 0.9, 30, 0.0, 25, 0.1), 1),
    ((0, 1, 0, 3, 0.0, 30, 0.0, 14, 0.0), 1), ((0, 1, 0, 1, 1.0, 25, 0.0, 35, 0.0), 1), ((0, 1, 0, 8, 0.0, 1, 1.0, 9, 0.0), 1),
    ((0, 1, 0, 20, 0.0, 30, 0.0, 4, 1.0), 1), ((0, 1, 0, 9, 0.0, 2, 1.0, 3, 1.0), 1), ((0, 1, 0, 2, 0.0, 1, 1.0, 2, 1.0), 1),
    ((0, 1, 1, 4, 0.0, 1, 1.0, 5, 1.0), 1), ((0, 1, 0, 33, 0.2, 12, 1.0, 6, 1.0), 1), ((0, 1, 0, 5, 0.0, 0, 0.0, 2, 1.0), 1),
    ((0, 1, 0, 4, 0.0, 50, 0.0, 0, 0.0), 1), ((0, 1, 0, 3, 0.5, 12, 0.0, 2, 1.0), 1), ((0, 1, 0, 1, 0.0, 0, 0.0, 0, 0.0), 1),
    # pages of one block
    ((0, 0, 0, 1, 0.0, 0, 0.0, 0, 0.0), 1), ((0, 0, 0, 4, 0.0, 0, 0.0, 0, 0.0), 1), ((0, 0, 0, 30, 0.1, 0, 0.0, 0, 0.0), 1),
    # pages without an article element
    ((0, 0, 1, 5, 0.0, 2, 1.0, 60, 0.0), 1), ((0, 0, 1, 3, 0.0, 40, 0.0, 50, 0.0), 1), ((0, 0, 1, 8, 0.0, 0, 0.0, 30, 0.0), 1),
    ((0, 0, 0, 60, 0.0, 5, 0.0, 70, 0.0), 1), ((0, 0, 0, 25, 0.1, 60, 0.0, 45, 0.0), 1), ((0, 0, 0, 90, 0.2, 1, 1.0, 2, 1.0), 1),
    ((0, 0, 0, 14, 0.0, 30, 0.0, 40, 0.0), 1), ((0, 0, 0, 18, 0.0, 3, 1.0, 60, 0.0), 1), ((0, 0, 0, 200, 0.0, 0, 0.0, 4, 0.0), 1),
    ((0, 0, 0, 12, 0.0, 70, 0.0, 4, 0.0), 1), ((0, 0, 0, 40, 0.3, 50, 0.1, 10, 1.0), 1), ((0, 0, 0, 7, 0.0, 0, 0.0, 9, 0.0), 1),
]


def model() -> Node:
    return grow([r for r, _ in LABELLED], [y for _, y in LABELLED])


def _named(value: str) -> tuple[float, bool]:
    """How strongly a class or id names boilerplate, and whether it names the main part."""
    most, main = 0.0, False
    for name in value.split():
        words = _words.findall(_camel.sub(r"\1-\2", name).lower())
        if words and words[0] in NOT_ITSELF:
            continue
        strong, weak, good = (sum(w in some for w in words) for some in (STRONG, WEAK, MAIN_WORDS))
        main = main or good > 0
        if strong:
            most = max(most, 0.9 if strong + weak == len(words) else 0.7)
        elif weak and not good:
            most = max(most, 0.5 if weak == len(words) else 0.3)
    return most, main


class _Reader:
    """One pass over a page."""

    def __init__(self, html: str):
        self.html, self.at = html, 0
        self.found: list[tuple[str, float, int, int, int, int]] = []  # text, boiler, inside, heading, words, characters in links
        self.stack: list[tuple[str, float, bool, bool, bool, dict | None]] = []  # tag, boiler and link before it, main part, hidden, places before it
        self.open: dict[str, int] = {}
        self.places: dict[str, int] = {}  # of open elements of SELF_ENDING within the innermost scope
        self.parts: list[str] = []
        self.boiler, self.inside, self.heading, self.hidden = 0.0, 0, 0, 0
        self.link, self.linked = False, 0
        self.no_more: set[str] = set()  # quotes that do not occur any more
        self.ends: dict[str, list[int]] = {}  # of elements of SKIP: where their end tags begin

    def text(self, piece: str) -> None:
        if piece and not self.hidden:
            if "&" in piece:
                piece = unescape(piece)
            self.parts.append(piece)
            if self.link:
                self.linked += len(piece.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((text, self.boiler, int(self.inside > 0), int(self.heading > 0), text.count(" ") + 1, self.linked))
        self.parts, self.linked = [], 0

    def attributes(self) -> tuple[list[tuple[str, str]], bool, bool]:
        """(attributes, whether it closes itself, whether the tag ends at all) from here; moves behind the tag."""
        html, got, slash = self.html, [], False
        while True:
            self.at = _space.match(html, self.at).end()
            if self.at >= len(html):
                return got, False, False
            if html[self.at] == ">":
                slash = html[self.at - 1] == "/"
                self.at += 1
                return got, slash, True
            m = _attr.match(html, self.at)
            name, self.at, value = m[1].lower(), m.end(), ""
            if m.end() > m.end(1) and "=" in html[m.end(1) : m.end()]:
                q = html[self.at : self.at + 1]
                end = -1
                if q in ('"', "'") and q and q not in self.no_more:
                    end = html.find(q, self.at + 1)
                    if end < 0:
                        self.no_more.add(q)
                if end >= 0:
                    value, self.at = html[self.at + 1 : end], end + 1
                elif q in ('"', "'") and q:
                    self.at = len(html)
                else:
                    b = _bare.match(html, self.at)
                    value, self.at = b[0], b.end()
                    if value.endswith("/") and html[self.at : self.at + 1] == ">":
                        value = value[:-1]
            got.append((name, unescape(value) if "&" in value else value))

    def marks(self, tag: str, attrs: list[tuple[str, str]]) -> tuple[float, bool, bool]:
        """(boiler, main part, hidden) of an element."""
        bad, main, hidden = 0.0, False, False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _hides.search(value):
                hidden = True
            elif name == "role":
                role = value.strip().lower()
                bad = max(bad, float(role in BOILER_ROLES))
                main = main or role in ("main", "article")
            elif name in ("class", "id"):
                b, m = _named(value)
                bad, main = max(bad, b), main or m and tag in ("div", "section", "td")
        if tag in BOILER_TAGS or tag == "header" and not self.inside:
            bad = 1.0
        if tag in ("html", "body"):
            bad, main = 0.0, False
        if tag in ("article", "main"):
            main = True
            if bad == 0.5:
                bad = 0.9  # an article that is a comment, or related, is no main text
        return bad, main and bad < 0.6, hidden

    def push(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        bad, main, hidden = self.marks(tag, attrs)
        before = None
        if tag in SELF_ENDING:
            self.places[tag] = len(self.stack)
        elif tag in SCOPE:
            before, self.places = self.places, {}
        self.stack.append((tag, self.boiler, self.link, main, hidden, before))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.boiler = max(self.boiler, bad)
        self.inside += main
        self.hidden += hidden
        self.heading += tag in HEADINGS

    def pop(self) -> None:
        tag, self.boiler, link, main, hidden, before = self.stack.pop()
        self.link = self.link and link  # a link that was not closed ends with the element it stands in
        self.open[tag] -= 1
        self.inside -= main
        self.hidden -= hidden
        self.heading -= tag in HEADINGS
        if tag in SELF_ENDING:
            if self.places.get(tag) == len(self.stack):
                del self.places[tag]
        elif before is not None:
            self.places = before

    def skip(self, tag: str) -> None:
        """Moves behind an element whose contents are no text; without an end tag only raw text goes on to the end."""
        if tag not in self.ends:
            self.ends[tag] = [m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])" + (r"|<body(?=[\s/>])" if tag == "head" else ""), self.html, re.I)]
        k = bisect_left(self.ends[tag], self.at)
        if k < len(self.ends[tag]):
            self.at = self.ends[tag][k]
            if self.html[self.at + 1] == "/":
                self.at = self.html.find(">", self.at) + 1 or len(self.html)
        elif tag in RAW:
            self.at = len(self.html)

    def tag(self) -> None:
        """Reads what begins with ``<`` here."""
        html, at = self.html, self.at
        m = _plain_tag.match(html, at)
        attrs: list[tuple[str, str]] = []
        closing, slash = False, False
        if m:
            closing, tag, self.at = bool(m[1]), m[2].lower(), m.end()
        else:
            after = html[at + 1 : at + 2]
            if after in ("!", "?") and after:
                if html.startswith("<!--", at):
                    end = at + 4 if html.startswith((">", "->"), at + 4) else html.find("-->", at + 4)
                    self.at = len(html) if end < 0 else html.find(">", end) + 1
                else:
                    self.at = html.find(">", at) + 1 or len(html)
                return
            closing = after == "/"
            n = _name.match(html, at + 1 + closing)
            if not n:
                if closing:  # "</" before anything else is a comment
                    self.at = html.find(">", at) + 1 or len(html)
                else:
                    self.text("<")
                    self.at = at + 1
                return
            tag, self.at = n[0].lower(), n.end()
            attrs, slash, ends = self.attributes()
            if not ends:
                return
        block = tag in BLOCK
        if block:
            self.flush()
        if closing:
            if tag == "a":
                self.link = False
            if (block or self.hidden) and self.open.get(tag):
                while self.stack[-1][0] != tag:
                    self.pop()
                self.pop()
            return
        if tag in SKIP:
            if not slash:
                self.skip(tag)
            return
        if tag == "br":
            self.text(" ")
        elif tag in VOID:
            return
        elif tag == "a":
            self.link = True
        if block or self.hidden and tag not in VOID or attrs and tag != "br" and self.marks(tag, attrs)[2]:
            if slash:  # written as empty
                return
            if tag in SELF_ENDING and tag in self.places:
                while len(self.stack) > self.places.get(tag, len(self.stack)):
                    self.pop()
            self.push(tag, attrs)

    def blocks(self) -> list[tuple[str, float, int, int, int, int]]:
        html, end = self.html, len(self.html)
        while self.at < end:
            k = html.find("<", self.at)
            self.text(html[self.at : k if k >= 0 else end])
            if k < 0:
                break
            self.at = k
            self.tag()
        self.flush()
        return self.found


def blocks(html: str) -> list[tuple[str, tuple[float, ...]]]:
    """The non-empty text blocks of a page in order, with the features of each."""
    found = _Reader(html).blocks()
    shape = [(0.0, 0.0), *((float(b[4]), min(1.0, b[5] / len(b[0]))) for b in found), (0.0, 0.0)]
    return [(b[0], (b[1], float(b[2]), float(b[3]), *shape[k], *shape[k - 1], *shape[k + 1])) for k, b in enumerate(found, 1)]


def main_text(html: str | None, tree: Node) -> str:
    """The blocks that the tree keeps, joined by newlines."""
    return "\n".join(text for text, row in blocks(html or "") if predict(tree, row) >= 0.5)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to the columns ``keep``, one row per page."""
    ship(df.sparkSession)
    tree = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 0, 256):
                texts = [main_text(h, tree) for h in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars bigint"
    return df.select(F.col(html_col).cast("string"), *(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
