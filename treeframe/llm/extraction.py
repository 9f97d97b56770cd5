"""Main-text extraction by line-block distribution.

Markup is stripped to lines, one for each block element that has text; menus, adverts, forms and other named boilerplate
go, and text within links has no weight. The weights of ``WINDOW`` consecutive lines are summed. Where that sum surges
over a threshold, derived from the page's largest sum, the article begins, and where it dives for the last time it ends.
Both are moved outward over adjoining headings and unlinked blocks of the same container (any line, within an article),
and all lines between are kept, links too. If the page names its article (article, main) and that holds a third of the
unlinked text at least, its lines have ``BONUS`` times the weight; smaller ones, such as teaser cards, have no bonus.

Boilerplate is named by its element, its role or a word of its class or id. A class of several words, such as
``post-comments``, counts by its words, but not one that only says what is in the element (``has-sidebar``) or that belongs
to the article (``entry-header``); and a name of layout, not of comments, is no reason to drop the greater part of the
page's text. Tags are found in one pass: a quote that a tag does not close ends where the tag would without it.

Nulls: a null html is empty, and its text is the empty string. Repeated rows, null ids and urls are carried. Pages are
processed whole; memory is that of one Arrow batch.
"""

from __future__ import annotations

import bisect
import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.llm.common import table

WINDOW = 3
#: An article (or main) with 1 / SHARE of the page's unlinked text has BONUS times its weight.
SHARE, BONUS = 3, 3
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STEP = re.compile(r">|=[ \t\n\r\f]*([\"'])")
_RAW = frozenset("script style noscript template svg iframe textarea select title object math".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_DROPPED = frozenset("nav footer aside form menu dialog button label fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NOISE = frozenset("ad ads advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promoted promotion related remark remarks replies reply respond search share sharing sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subscribe subscription teaser toc toolbar topbar widget widgets".split())
_ARTICLES = frozenset(("article", "main"))
_CONTAINERS = _ARTICLES | frozenset("div section td th center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: Words of a class that say the rest is about something else, words of an article's own parts, and noise that may be long.
_ABOUT, _OWN, _TALK = frozenset("has have with no without is not show hide".split()), frozenset("entry article post story content section".split()), frozenset("comment comments commentlist disqus remark remarks replies reply respond".split())


def _noisy(attributes: str) -> set[str]:
    """The words of noise that name an element."""
    found: set[str] = set()
    if "=" not in attributes:
        return found
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            hit = _NOISE.intersection(words)
            if len(words) > 1 and (words[0] in _ABOUT or hit == {"header"} and not _OWN.isdisjoint(words)):
                continue
            found |= hit
    return found


class _Token(NamedTuple):
    start: int
    end: int
    name: str  # of a tag, else empty
    closing: bool
    attributes: str
    raw: str  # the name of an element that was taken as a whole
    text: str  # of a CDATA section


def _tokens(page: str) -> list[_Token]:
    """Tags, comments, declarations and raw elements, in one pass."""
    out: list[_Token] = []
    last, at = page.rfind(">"), 0
    ends: dict[str, list[int]] = {}

    def raw_end(name: str, at: int) -> int:
        """Where the element's end tag ends, or the page."""
        if name not in ends:
            ends[name] = [m.end() for m in re.finditer(rf"</{name}\s*>", page, re.I)][::-1]
        stops = ends[name]
        while stops and stops[-1] <= at:
            stops.pop()
        return stops[-1] if stops else len(page)

    while m := _OPEN.search(page, at):
        start, word = m.start(), m[0]
        if word == "<!--":
            k = page.find("-->", start + 4)
            at = len(page) if k < 0 else k + 3
            out.append(_Token(start, at, "", False, "", "", ""))
        elif word == "<![CDATA[":
            k = page.find("]]>", start + 9)
            at = len(page) if k < 0 else k + 3
            out.append(_Token(start, at, "", False, "", "", page[start + 9 : len(page) if k < 0 else k]))
        elif start > last:
            break  # no tag ends any more; the rest is text
        elif not m[2]:
            at = page.find(">", start) + 1
            out.append(_Token(start, at, "", False, "", "", ""))
        else:
            at = m.end()
            while (step := _STEP.search(page, at)) and step[1]:
                close = page.find(step[1], step.end())
                inner = page[step.end() : close] if close >= 0 else ""
                gt = inner.find(">")
                if close < 0 or 0 <= gt < inner.rfind("<") and "<" not in inner[:gt]:
                    at = page.find(">", step.end())  # the quote is never closed
                    if at < 0:
                        at = last
                    step = None
                    break
                at = close + 1
            stop = step.start() if step else max(at, m.end())
            if page[stop : stop + 1] != ">":
                stop = page.find(">", m.end())
            name, at = m[2].lower(), stop + 1
            if name in _RAW and not m[1]:
                at = raw_end(name, at)
                out.append(_Token(start, at, "", False, "", name, ""))
            else:
                out.append(_Token(start, at, name, bool(m[1]), page[m.end() : stop], "", ""))
    return out


def _collapsed(s: str) -> str:
    return " ".join(html_lib.unescape(s).split())


class _Line(NamedTuple):
    text: str
    weight: int  # its characters outside of links
    articles: tuple[int, ...]  # the open article and main elements, outermost first
    box: int  # the innermost open container
    tag: str


class _Lines:
    def __init__(self) -> None:
        self.lines: list[_Line] = []
        self.parts: list[tuple[str, bool]] = []
        self.open: list[tuple[str, int]] = []  # containers
        self.boxes = 0

    def text(self, s: str, link: bool) -> None:
        self.parts.append((s, link))

    def end(self, tag: str) -> None:
        if text := _collapsed("".join(s for s, _ in self.parts)):
            linked = sum(len(_collapsed("".join(s for s, _ in run))) for link, run in groupby(self.parts, lambda x: x[1]) if link)
            articles = tuple(i for name, i in self.open if name in _ARTICLES)
            self.lines.append(_Line(text, max(0, len(text) - linked), articles, self.open[-1][1] if self.open else 0, tag))
        self.parts = []

    def enter(self, name: str) -> None:
        self.boxes += 1
        self.open.append((name, self.boxes))

    def leave(self, name: str) -> None:
        """Closes the innermost container of that name; a stray end tag closes no article but by the article's name."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                return
            if self.open[i][0] in _ARTICLES and name not in _ARTICLES:
                return

    @property
    def inside(self) -> bool:
        return any(name in _ARTICLES for name, _ in self.open)


def _ends(tokens: list[_Token]) -> dict[int, int]:
    """Offsets of start tags and of their end tags, where those stand in the same article (or main)."""
    open_: dict[str, list[tuple[int, int]]] = {}  # by name: offsets of the start tag and of the article around it
    articles: list[tuple[str, int]] = []
    out = {}
    for t in tokens:
        name = t.name
        if not name or name in _VOID or t.attributes.endswith("/"):
            continue
        around = articles[-1][1] if articles else -1
        if name in _ARTICLES:
            if not t.closing:
                articles.append((name, t.start))
            elif (k := next((k for k in range(len(articles) - 1, -1, -1) if articles[k][0] == name), -1)) >= 0:
                out[articles[k][1]] = t.start
                del articles[k:]
        elif not t.closing:
            open_.setdefault(name, []).append((t.start, around))
        elif stack := open_.get(name):
            while stack and stack[-1][1] > around:
                stack.pop()  # its article ended first
            if stack and stack[-1][1] == around:
                out[stack.pop()[0]] = t.start
    return out


class _Shares:
    """How much of the page's text stands between two offsets."""

    def __init__(self, page: str, tokens: list[_Token]):
        self.at, self.sum = [0], [0]
        before, link = 0, 0
        for t in tokens:
            own = 0 if link else len(page[before : t.start].strip())
            self.at.append(t.start), self.sum.append(self.sum[-1] + own)
            before = t.end
            if t.name == "a":
                link = not t.closing
            elif t.name in _BLOCKS:
                link = 0
        self.all = self.sum[-1] + len(page[before:].strip())

    def mostly(self, a: int, b: int) -> bool:
        upto = lambda x: self.sum[bisect.bisect_right(self.at, x) - 1]
        return 2 * (upto(b) - upto(a)) > self.all


def lines_of(page: str) -> list[_Line]:
    """The lines that have text."""
    out = _Lines()
    tokens, ends, shares = _tokens(page), None, None
    skip, depth, until = "", 0, -1  # the dropped element that is open, how many of its name, its end tag's offset
    link, tag, at = 0, "", 0
    for t in tokens:
        if t.start > at and not skip:
            out.text(page[at : t.start], link > 0)
        at, name, closing = t.end, t.name, t.closing
        if not name:
            if t.text and not skip:
                out.text(t.text, link > 0)
            elif t.raw and not skip and t.raw not in ("svg", "math"):
                out.text(" ", False)
            continue
        empty = t.attributes.endswith("/")
        if skip and until >= 0:
            if t.start == until:
                skip = ""
            continue
        if skip:
            if name == skip:
                depth += -1 if closing else 0 if empty else 1
                if not depth:
                    skip = ""
                continue
            if not (name in _ARTICLES and not closing and skip != "aside") and not (closing and name in ("article", "main", "body", "html")):
                continue
            skip, depth = "", 0  # the dropped element was never closed
        if name in _BLOCKS:
            out.end(tag)
            tag, link = ("" if closing else name), 0
        elif name == "br":
            out.text(" ", False)
        elif name == "a":
            link = 0 if closing else 1
        dropped = not closing and name not in _VOID and name not in ("main", "body", "html", "head") and not empty and (name in _DROPPED or name == "header" and not out.inside)
        if not dropped and not closing and not empty and name not in _VOID and name not in ("main", "body", "html", "head") and (words := _noisy(t.attributes)):
            if name not in _BLOCKS and name not in ("span", "ins"):
                continue
            ends = _ends(tokens) if ends is None else ends
            shares = _Shares(page, tokens) if shares is None else shares
            dropped = not (words.isdisjoint(_TALK) and name != "article" and t.start in ends and shares.mostly(t.start, ends[t.start]))
        if dropped:
            ends = _ends(tokens) if ends is None else ends
            skip, depth, until = name, 1, ends.get(t.start, -1)
        elif closing and name in ("body", "html"):
            out.open.clear()
        elif name in _CONTAINERS:
            out.leave(name) if closing else out.enter(name)
    if at < len(page) and not skip:
        out.text(page[at:], link > 0)
    out.end(tag)
    return out.lines


def _adjoins(line: _Line, edge: _Line) -> bool:
    """Whether a line beside the text's edge belongs to the text: any of the same article, headings and prose of the same container."""
    if line.articles or edge.articles:
        return bool(line.articles) and line.articles[-1] in edge.articles
    return line.box == edge.box and (line.tag in _HEADINGS or 2 * line.weight >= len(line.text))


def main_text(page: str | None, window: int = WINDOW) -> str:
    lines = lines_of(page or "")
    n, free = len(lines), Counter()
    for x in lines:
        free.update(dict.fromkeys(x.articles, x.weight))
    total = sum(x.weight for x in lines)
    main = {i for i, k in free.items() if k * SHARE >= total}
    weights = [x.weight * (1 if main.isdisjoint(x.articles) else BONUS) for x in lines]
    sums = [sum(weights[i : i + window]) for i in range(n)]
    most = max(sums, default=0)
    if not most:
        return ""
    top = sums.index(most)
    limit = 0.3 * most
    if all(main.isdisjoint(x.articles) for x in lines[top : top + window]):
        limit = min(120.0, limit)
    surges = [i for i in range(n) if sums[i] >= limit]
    # a window over the limit has a line of at least its share
    begin = next(i for i in range(surges[0], n) if weights[i] * window >= limit)
    end = next(i for i in range(min(n, surges[-1] + window) - 1, -1, -1) if weights[i] * window >= limit)
    while begin > 0 and _adjoins(lines[begin - 1], lines[begin]):
        begin -= 1
    while end < n - 1 and _adjoins(lines[end + 1], lines[end]):
        end += 1
    return "\n".join(x.text for x in lines[begin : end + 1])


def extract(df: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", window: int = WINDOW) -> DataFrame:
    """A row for each page: its id and url, text, n_chars."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(x, window) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], names=[id_col, url, "text", "n_chars"])

    return df.select(F.col(id_col), F.col(url), F.col(html)).mapInArrow(run, f"`{id_col}` {kind}, `{url}` string, text string, n_chars bigint")


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
