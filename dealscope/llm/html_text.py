"""Main text of web pages by line-block distribution.

The markup is stripped into lines, one per block element. Menus, headers,
footers, asides, forms, adverts, notices and reader comments (by element, role,
or class and id words) become lines without text. The text lengths of the lines,
weighted by their elements, form the distribution: link text weighs nothing
but in articles, headings and paragraphs. A region begins where the sum over a
sliding window of ``WINDOW`` lines surges from nothing, at its first line of
any weight, and ends at the last before the sum dives back; all lines in between
belong to it, link lists too. Every region counts, wherever it stands.

Class, id and role names mark an element if all their words speak of boilerplate or of mere layout (``site-header``, not
``share-price``). A marked element that is never closed ends at the next block element.

Defined results: null or empty html gives an empty text and 0 characters; pages
without text likewise; unclosed comments and scripts run to the end of the page; very long pages are treated whole, in linear time; an
empty table gives no rows; repeated rows are treated row by row; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import table

WINDOW = 3
_DROP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg|iframe|object|canvas|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>")
_ATTR = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: elements that hold no article text
_BOILER = frozenset("head nav header footer aside form menu dialog select button audio video map".split())
#: words of class, id and role that mark such elements
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar aside menu nav navbar navigation topnav breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus replies reply respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets pagination pager toolbar copyright search complementary contentinfo".split()
)
#: words that say where such an element stands
_LAYOUT = frozenset("left right top bottom upper lower main site page global primary secondary sticky fixed box block wrapper wrap container inner outer area section list item items link links bar panel row col column content text body title form input button buttons icon icons group user users post article blog web mobile desktop js c o l m".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: elements whose links are text, and whose ids and classes say nothing of their role
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _marked(attributes: str) -> bool:
    for m in _ATTR.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w and not w.isdigit()}
            if not _WORDS.isdisjoint(words) and words <= _WORDS | _LAYOUT:
                return True
    return "hidden" in attributes.lower().split()


def _closed(tags: list[re.Match]) -> set[int]:
    """Numbers of the opening tags that have a closing one."""
    found, stack, open_ = set(), [], {}
    for i, m in enumerate(tags):
        tag = m[2].lower()
        if not m[1]:
            if tag not in _VOID:
                stack.append((tag, i))
                open_[tag] = open_.get(tag, 0) + 1
        elif open_.get(tag):
            while True:
                top, at = stack.pop()
                open_[top] -= 1
                if top == tag:
                    found.add(at)
                    break
    return found


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, weight) of every line; lines of dropped elements are empty."""
    page = _DROP.sub(" ", page)
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    linked = at = article = link = prose = 0
    skip, depth, brief = "", 0, False

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(buffer)).split())
        if text:
            out.append((text, len(text) if article or prose else max(0, len(text) - linked)))
        buffer.clear()
        linked = 0

    tags = list(_TAG.finditer(page))
    closed = _closed(tags)
    for number, m in enumerate(tags):
        if brief and m[2].lower() in _BLOCK:  # an unclosed mark holds what stands before the next block
            skip, brief, at = "", False, m.start()
            out.append(("", 0))
        if m.start() > at and not skip:
            piece = page[at : m.start()]
            buffer.append(piece)
            if link:
                linked += len(piece)
        at = m.end()
        close, tag = bool(m[1]), m[2].lower()
        if skip:
            if tag == skip and not m[0].endswith("/>"):
                depth += -1 if close else 1
                if not depth:
                    skip, brief = "", False
                    out.append(("", 0))
            elif close and tag in ("body", "html") or close and tag == "article" and article and skip == "p":
                skip, depth, brief = "", 0, False
            if skip or tag not in ("article", "main"):
                continue
        if tag in _BLOCK:
            flush()
            prose = tag in _PROSE and not close
        elif tag == "br":
            buffer.append(" ")
        if tag in ("article", "main"):
            article = max(0, article + (-1 if close else 1))
        if tag == "a":
            link = 0 if close else 1
        if close or tag in _VOID or tag in ("html", "body", "article", "main"):
            continue
        if tag in _BOILER and not (tag == "header" and article) or (tag in _BLOCK - _PROSE or tag in ("span", "ins", "iframe")) and _marked(m[3]):
            flush()
            skip, depth, brief = tag, 1, number not in closed
    if not skip:
        buffer.append(page[at:])
    flush()
    return out


def main_text(page: str | None, window: int = WINDOW) -> str:
    lines = lines_of(page or "")
    size = np.array([n for _, n in lines], int)
    # the sum over a window leaves zero at a surge and is back at a dive, window - 1 lines after the last weight
    total = np.convolve(size, np.ones(window, int)) if len(size) else size
    edge = np.flatnonzero(np.diff(np.concatenate([[False], total > 0, [False]]).astype(int)))
    return "\n\n".join(lines[i][0] for s, e in zip(edge[::2], edge[1::2] - window + 1) for i in range(s, e) if lines[i][0])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page row."""

    def work(batches):
        for b in tk.slices(batches, "html"):
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars bigint")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
