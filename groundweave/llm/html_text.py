"""Operator 8, main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text, and an empty one where an element that isn't a paragraph, heading, list or table begins or
ends. A line inside a menu, header, footer, sidebar, notice, advert, form or comment section is no line; one that stands
outside articles and is mostly of links measures nothing. Lengths are summed over windows of WINDOW lines. Where a sum rises above
SURGE there is main text (surge point); it reaches, forward and back, to where the sum falls to DIVE (dive points).
The lines between these points are kept, in page order.

A surge is told by lengths alone. For a dive, a line in a paragraph or the like counts PARAGRAPH characters more and one in an
article ARTICLE more, and empty lines that follow each other in an article count once: short paragraphs there are
text, where short blocks in bare elements (contacts, rights) end it. So an article is kept if text surges in it, not for its mark.
Windows don't reach across the border of an article, so that small articles (cards, insets) surge by their own text alone.
What is no line and interrupts lines of one article or one block takes no place in a window.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.llm.common import table, text_batches

WINDOW = 3
SURGE, DIVE = 80, 20
#: What a line in a paragraph, heading, list or table, and one in an article, counts more before a dive.
PARAGRAPH, ARTICLE = 20, 30
#: Above this share of its characters in links, a line outside an article measures nothing.
LINKS = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
# Elements and names by their part in a page.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img picture".split())
_OUTSIDE = frozenset("head nav footer aside form button select option noscript template svg canvas object audio video dialog menu fieldset datalist input".split())
_MAIN = frozenset("article main".split())
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead topbar footer sidebar widget aside ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall comment comments respond replies disqus share sharing social related recommended"
    " hidden search form header copyright disclaimer".split()
)
# Words that name a part of a page only together with others of _NAMES, as in an article they are words like others.
_SHAPES = frozenset("area bar block box button buttons container content group inner item items link links list panel section slot title unit wrap wrapper".split())
_PAGE = frozenset(
    "site page main top bottom global primary secondary left right sticky fixed mobile desktop post posts user reader readers thread count body row col column inline inner outer wide"
    " articles stories popular recent latest trending more mini sub icon icons text message zone unit placement slot".split()
)
_PLAIN = frozenset("alert banner comment copyright disclaimer form header hidden menu notice notices related respond search share sharing social".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def _outside(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element opens a part of the page that isn't main text. A name must be of words for such parts as a
    whole (share-buttons, not related-work or search-results); paragraphs and the like aren't judged by words of _PLAIN alone."""
    if tag in _OUTSIDE:
        return True
    if tag == "header":
        return not in_main
    if not attributes or tag in ("html", "body") or tag in _MAIN:
        return False
    given = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return True
    if given.get("role") in _ROLES and not (in_main and given["role"] == "banner"):
        return True
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        parts = _WORD.findall(name)
        if parts and parts[0] not in ("has", "with", "no", "without", "is"):
            hit = _NAMES.intersection(parts)
            if hit == {"header"}:  # of the page, not of its text
                if not in_main and "content" not in parts and _PAGE.union(("header", "wrapper", "container", "bar")).issuperset(parts):
                    return True
            elif hit and _NAMES.union(_SHAPES, () if in_main else _PAGE).issuperset(parts) and not (tag in _TEXT and _PLAIN.issuperset(hit)):
                return True
    return False


class Line(NamedTuple):
    text: str
    outside: bool
    links: float  # share of its characters
    article: int  # number of the article or main element, 0 without one
    block: int  # number of the nearest element that isn't a paragraph, list or the like
    paragraph: bool = False  # whether it stands in one of these


def _structural(tag: str) -> bool:
    return tag not in _INLINE and tag not in _TEXT and tag not in ("br", "hr")


def page_lines(page: str) -> list[Line]:
    """Lines of a page, in order, empty ones at the borders of elements that aren't paragraphs or the like. An article that is the only one in another counts as that one."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, int, int, bool]] = []  # element; outside, main, block and paragraph around it
    depth: Counter[str] = Counter()  # open elements by name
    text: list[str] = []
    parents: dict[int, int] = {}
    linked = number = main = block = 0
    outside = paragraph = False

    def border() -> None:
        if lines and not outside:
            lines.append(Line("", False, 0.0, main, block))

    def end() -> None:
        nonlocal text, linked
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                lines.append(Line(line, outside, linked / max(1, sum(map(len, text))), main, block, paragraph))
        text, linked = [], 0

    def close(tag: str) -> None:
        """Closes the innermost open element of this name and those in it."""
        nonlocal outside, main, block, paragraph
        last = ""
        while last != tag:
            if _structural(stack[-1][0]):
                border()
            last, outside, main, block, paragraph = stack.pop()
            depth[last] -= 1

    at, n = 0, len(page)
    links = 0
    while at < n:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else n
        if stop > at:
            text.append(page[at:stop])
            if links:
                linked += stop - at
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag == "br":
                text.append(" ")
            if depth[tag]:
                if tag not in _INLINE:
                    end()
                close(tag)
            elif tag not in _INLINE:
                end()
            continue
        if tag in _RAW:
            after = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = after.end() if after else n
            continue
        if tag == "br":
            text.append(" ")
        if tag not in _INLINE and tag != "br":
            end()
            if tag in _CLOSES_P and any(x[0] == "p" for x in stack[-3:]):
                close("p")
            elif tag == "li" and stack and stack[-1][0] == "li":
                close("li")
        if tag in _VOID or found[3].rstrip().endswith("/"):
            continue
        if tag == "a":
            links += 1
        away = _outside(tag, found[3], main > 0)
        centre = tag in _MAIN or "articlebody" in found[3].lower() or 'role="main"' in found[3].lower()
        if (away and not outside or centre) and tag in _INLINE:
            end()
        if _structural(tag) and not away:
            border()
        number += 1
        stack.append((tag, outside, main, block, paragraph))
        depth[tag] += 1
        outside = outside or away
        paragraph = tag in _TEXT or tag in _INLINE and paragraph
        if tag not in _TEXT and tag not in _INLINE:
            block = number
        if centre:
            parents[number] = main
            main = number
    end()
    return _joined(lines, parents)


def _joined(lines: list[Line], parents: dict[int, int]) -> list[Line]:
    """The lines with every article that is the only one with text in another joined to it."""
    used: set[int] = set()
    for line in lines:
        at = 0 if line.outside or not line.text else line.article
        while at and at not in used:
            used.add(at)
            at = parents[at]
    inner = Counter(parents[x] for x in used)
    root: dict[int, int] = {0: 0}
    for x in sorted(parents):  # an element's number is above that of the one around it
        root[x] = root[parents[x]] if parents[x] and inner[parents[x]] == 1 else x
    return [line._replace(article=root[line.article]) for line in lines]


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> list[str]:
    """The lines between the surge and dive points of the line-block distribution."""
    parts: dict[int, list[int]] = {}  # places in lines by article; -1: a place that measures nothing
    last: dict[int, int] = {}
    for i, line in enumerate(lines):
        if line.outside:
            continue
        own = parts.setdefault(line.article, [])
        if not line.text:
            if not line.article or own and own[-1] >= 0:
                own.append(-1)
            continue
        if not line.article and 0 in last and lines[last[0]].block != line.block:  # what lies between as other text parts two blocks
            own.extend(-1 for _ in islice((k for k in range(last[0] + 1, i) if lines[k].text), window))
        own.append(i)
        last[line.article] = i
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for article, own in parts.items():
        counts = [i >= 0 and (article or lines[i].links <= LINKS) for i in own]
        size = np.array([len(lines[i].text) if c else 0 for i, c in zip(own, counts, strict=True)])
        more = np.array([c * (ARTICLE if article else PARAGRAPH if lines[i].paragraph else 0) for i, c in zip(own, counts, strict=True)])
        n = len(own)
        blocks = []
        for x in (size, size + more):
            sums = np.concatenate([[0], np.cumsum(x)])
            blocks.append(sums[np.minimum(np.arange(n) + window, n)] - sums[:n])
        found[article] = (size, *blocks)
    most = max((b[1].max() for b in found.values() if len(b[1])), default=0)
    if not most:
        return []
    level = surge if most > surge else most - 1  # a page of short lines alone: its largest block
    kept: list[int] = []
    for article, own in parts.items():
        size, block, weighed = found[article]
        text = (weighed > min(dive, level)) | (block > level)
        at = 0
        while at < len(own):
            end = at
            while end < len(own) and text[end]:
                end += 1
            if (block[at:end] > level).any():
                kept += [i for i, n in zip(own[at:end], size[at:end], strict=True) if n]
            at = max(end, at + 1)
    return [lines[i].text for i in sorted(kept)]


def main_text(page: str) -> str:
    """The main text of a page: its kept lines with one space between."""
    return " ".join(main_lines(page_lines(page)))


def extract(df: DataFrame, html_col: str = "html", id_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per row of df: id_cols and text (empty if there is none).

    Null and empty pages have an empty text; broken or cut markup is read as far as it goes. Repeated rows stay; other
    columns are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="_page").assign(text=[main_text(p) if p else "" for p in b["_page"]])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)
    return df.select(*id_cols, F.col(html_col).alias("_page")).mapInPandas(run, f"{kinds}, text string")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    text_batches(spark)
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
