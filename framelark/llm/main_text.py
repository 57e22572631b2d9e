"""Main text of a page by the distribution of text over its lines.

Markup is stripped to one line for each block element; scripts, styles and
comments vanish.  A line's weight is the length of its text without links.
Lines in elements that never hold the article (menus, forms, asides, page
headers and footers, or containers whose class or id says advert, comment,
notice, sidebar and the like) weigh nothing.  Where the page marks its
article (``article``, ``main`` or the like), lines outside are stripped like those.

Weights are summed over windows of ``LINES`` lines.  Text surges where a
window reaches the threshold, or in lines of text joined to that place, and dives
where the windows fall back to nothing; all stretches between are the main
text, headings right above them included.  All lines between surge and dive that aren't of the
elements above are kept in full.  In a marked article any text reaches the
threshold, so that none of it is lost; it dives like other text, at ``LINES``
lines without text of their own (a list of links) or more.

Defined results: null or empty html gives an empty text; a page without
article text gives an empty text; pages of any length are parsed whole; a tag
that the page's end cuts off is dropped; repeated rows stay rows; stretches that tie are
all kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

LINES = 3
#: Share of the fullest window that a window must reach to surge.
SURGE = 0.12

# Element names and container words, after the HTML standard and common use.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas xmp noembed noframes".split())
NEVER = frozenset("nav menu aside footer form button select option dialog fieldset audio video map".split())
ARTICLE = frozenset("article main".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments disqus respond replies reply widget toolbar pagination pager copyright".split()
)
HEAD_WORDS = frozenset("header head top".split())
MAIN_WORDS = frozenset("content article post entry main story body text".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
_WORD = re.compile(r"[^a-z0-9]+")
_END = {name: re.compile(rf"</{name}\s*[^>]*>", re.I) for name in RAW}


class Line(NamedTuple):
    text: str
    weight: int
    kept: bool  # not of an element that never holds the article
    heading: bool


def _is_side(name: str, attributes: str, in_article: bool) -> bool:
    if name in NEVER:
        return True
    if name == "header" and not in_article:
        return True
    if not attributes:
        return False
    named = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes) if m[1]}
    flags = {m[5].lower() for m in _ATTRIBUTE.finditer(attributes) if m[5]}
    if "hidden" in flags or "hidden" in named or named.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", named.get("style", ""), re.I):
        return True
    if named.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"):
        return True
    if name in ("html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong", "a"):
        return False
    classes = f"{named.get('class', '')} {named.get('id', '')}".lower().split()
    if any(c in MAIN_WORDS for c in classes):
        return False
    words = {w for c in classes for w in _WORD.split(c)}
    return bool(words & SIDE_WORDS) or (not in_article and bool(words & HEAD_WORDS) and not words & MAIN_WORDS)


def _is_article(name: str, attributes: str) -> bool:
    return name in ARTICLE or bool(attributes) and bool(re.search(r"articlebody|role\s*=\s*[\"']?(?:main|article)\b", attributes, re.I))


def lines(page: str) -> tuple[list[Line], bool]:
    """The text lines of a page, and whether the page marks its article."""
    made: list[tuple[Line, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, side, article
    pieces: list[str] = []
    linked = side = article = 0
    heading = False

    def end() -> None:
        nonlocal linked, heading
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            made.append((Line(text, 0 if side else max(0, len(text) - linked), not side, heading), article > 0))
        pieces.clear()
        linked, heading = 0, False

    def pop(to: int) -> None:
        nonlocal side, article, links
        while len(stack) > to:
            _, s, a = stack.pop()
            side -= s
            article -= a
        if to < depth:  # an unclosed link ends with the element that it is in
            links = 0

    at = links = depth = 0  # depth: open elements around the link
    for_search = _TAG.search
    while found := for_search(page, at):
        piece = page[at : found.start()]
        if piece:
            pieces.append(piece)
            if links:
                linked += len(" ".join(html.unescape(piece).split()))
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                pieces.append(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if name in BLOCK:
            end()
        elif name == "br":
            pieces.append(" ")
        if closing:
            if name == "a":
                links = 0
            elif name not in VOID:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        pop(i)
                        break
                    if stack[i][2] and name not in ("body", "html", "article", "main"):
                        break  # a stray end tag doesn't close an article
            continue
        if name in RAW and not attributes.endswith("/"):
            close = _END[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        if name == "a":
            links, depth = int("href" in attributes.lower()), len(stack)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        if name in BLOCK or name in NEVER or name not in ("b", "i", "em", "strong", "span", "u", "small", "sup", "sub", "code", "font"):
            is_article = _is_article(name, attributes)
            if is_article and name in ARTICLE and article == 0:
                for i, (n, s, _) in enumerate(stack):  # an unclosed menu or header can't hold the article
                    if s and n in ("nav", "header", "ul", "form", "menu"):
                        pop(i)
                        break
                links = 0  # nor can an unclosed link
            is_side = _is_side(name, attributes, article > 0 or is_article)
            stack.append((name, is_side, is_article and not is_side))
            side += is_side
            article += stack[-1][2]
        elif attributes and _is_side(name, attributes, article > 0):
            stack.append((name, True, False))
            side += 1
        heading = heading or name in ("h1", "h2", "h3", "h4", "h5", "h6")
    pieces.append(page[at:])
    end()
    marked = any(a and line.kept for line, a in made)
    return [line if a or not marked else line._replace(weight=0, kept=False) for line, a in made], marked


def stretches(found: list[Line], marked: bool) -> list[tuple[int, int]]:
    """First line and line after the last of every stretch of main text."""
    place = [i for i, line in enumerate(found) if line.kept]  # the rest is stripped
    weights = [found[i].weight for i in place]
    n = len(place)
    sums = [sum(weights[max(0, i - LINES // 2) : i + LINES // 2 + 1]) for i in range(n)]
    threshold = 0 if marked else SURGE * max(sums, default=0)  # a page that marks its article leaves no other text to tell it from
    made, i, stop = [], 0, 0
    while i < n:
        if sums[i] < threshold or not weights[i]:
            i += 1
            continue
        surge = i
        while surge and weights[surge - 1]:  # text before the surge that is joined to it
            surge -= 1
        while i < n and sums[i] > 0:  # until the dive
            i += 1
        dive = i
        while not weights[dive - 1]:
            dive -= 1
        while surge > stop and found[place[surge - 1]].heading:
            surge -= 1
        made.append((place[surge], place[dive - 1] + 1))
        stop = dive
    return made


def extract(page: str | None) -> str:
    """The main text of a page: its blocks joined by an empty line."""
    found, marked = lines(page or "")
    return "\n\n".join(line.text for start, stop in stretches(found, marked) for line in found[start:stop] if line.kept)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for part in slices(batches, text="html"):
            texts = [extract(t) for t in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
