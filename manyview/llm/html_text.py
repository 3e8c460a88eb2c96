"""Main text of web pages by the distribution of text over lines.

A page's markup is taken off so that each block becomes a line; blocks of menus,
forms, notices and the like become empty lines, as markup does. The text lengths are
summed over a sliding window of lines. The sums surge where running text begins and
dive where it ends; the stretch from surge to dive with the most text is the core, of
every page. The core decides between elements: the innermost one that holds most of it
gives the text, or the article around it if there is one. All blocks of that element
are kept, so that short paragraphs at its ends are not lost, and what of the core stands
before it, a headline or a lead.

Some things that set an element apart are weak: a form may be around a whole page, and a
word within a longer class may mean something else ("side-by-side"). Where nothing else
has running text, the weakly marked element that holds the core is not set apart.

Elements are numbered in the order of the page and know what they inherit, so that time
grows with a page's length, however deep it is.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.llm.worker_code import ship

WINDOW = 3
#: Characters in a window of running text, if the page has any such.
SURGE = 80
#: The part of the core that an element must hold, and an article within another.
HOLDS, HOLDS_WITHIN = 0.7, 0.9
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements by their part in a page.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside form menu dialog button select option head".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_ITSELF = {"li": "li", "dt": "dt", "dd": "dd", "td": "td", "th": "th", "tr": "tr", "option": "option"}
#: Parts of forms that stand in a line.
CONTROLS = frozenset("button option".split())
#: Without their end they swallow the rest of a page; other raw elements are then passed over.
SWALLOWS = frozenset("script style".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "sidebar sidebars side menu menus nav navbar navigation navi breadcrumb breadcrumbs topbar footer foot header masthead comment comments commentlist respond "
    "disqus replies discussion related recommended recommendations share sharing social newsletter subscribe subscription signup login popup modal overlay "
    "widget widgets toolbar pagination pager copyright skip disclaimer alert".split()
)
# Words of a class, and elements, that tell of an article and are not its text.
BYLINE = frozenset("byline author authors date dateline time published updated meta metadata timestamp".split())
#: Marks that within a longer class may mean something else.
AMBIGUOUS = frozenset("side social widget widgets share sharing head header masthead banner notice notices alert overlay modal popup toolbar skip promo promotion subscription login signup".split())
#: Elements that may carry a mark for their layout, and words before one that make it no mark ("has-sidebar").
FRAMES = frozenset("html body main article".split())
LAYOUT = frozenset("has with no without not is in show hide".split())
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
LINK = re.compile(r"</(?=a\b)|<(?=a\b)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def set_apart(tag: str, attributes: str, in_main: bool, marked: bool = True) -> str:
    """"strong" or "weak" if an element is a menu, a form, an advert or another thing beside
    the article, "" if not; outside of articles, by its class and id only if ``marked``."""
    if tag == "form":
        return "weak"
    if tag in ASIDE:
        return "strong" if tag != "header" or not in_main else ""
    if not attributes:
        return ""
    weak = ""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
            return "strong"
        if tag in FRAMES:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return "weak" if value.strip().lower() == "form" else "strong"
        if (marked or in_main) and name in ("class", "id"):
            for mark in value.split():
                words = [w.lower() for w in SPLIT.split(mark) if w]
                # the header of an article, and a heading that is called one, are its text
                own = words and words[-1] == "header" and (tag in HEADINGS or in_main)
                if words and not own and words[0] not in LAYOUT and (words[0] in MARKS or words[-1] in MARKS):
                    found = {w for w in (words[0], words[-1]) if w in MARKS}
                    if len(words) == 1 or not found <= AMBIGUOUS:
                        return "strong"
                    weak = "weak"
    return weak


def byline(tag: str, attributes: str) -> bool:
    """Whether an element says who wrote an article, or when."""
    if tag in ("time", "address"):
        return True
    named = [a or b or c for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "rel", "itemprop")] if attributes else []
    return any(w.lower() in BYLINE for value in named for w in SPLIT.split(value))


@dataclass
class Element:
    """An open or closed element: the one around it, its last descendant, and what it
    passes on: whether it is in an article, set apart, in a header, in a heading or a
    paragraph, and the outermost weakly marked element that sets it apart."""

    tag: str
    parent: int
    main: bool = False
    in_main: bool = False
    away: bool = False
    header: bool = False
    heading: bool = False
    told: bool = False
    weak: int = 0
    last: int = 0


@dataclass
class Line:
    """A block's text (empty for what is set apart), the element around it, whether most of it are links, and what
    its length would be if weak marks did not count."""

    text: str
    element: int
    linked: bool
    hidden: int = 0


class Page:
    """The lines and elements of a page."""

    def __init__(self, html: str, marked: bool = True, spared: frozenset[int] = frozenset()):
        self.marked, self.spared = marked, spared
        ends = [(m.start(), m[0] == "</") for m in LINK.finditer(html)]
        #: Links that end before the next begins. An anchor that is left open is none.
        self.links = {at for (at, close), (_, next_close) in zip(ends, ends[1:], strict=False) if not close and next_close}
        self.lines: list[Line] = []
        self.elements = [Element("", -1)]
        self.open = [0]
        self.at: dict[str, list[int]] = defaultdict(list)  # places in ``open``, by tag
        self.blocks_open: list[int] = []  # places in ``open``
        self.text: list[str] = []
        self.linked = self.total = 0
        self.read(html)
        self.flush()
        self.close(1)
        self.elements[0].last = len(self.elements) - 1

    def flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            if words:
                inner = self.elements[self.open[-1]]
                # of an article's own header, only headings and paragraphs are text, but those that name the author
                beside = inner.header and (not inner.heading or inner.told)
                apart = inner.away or beside
                hidden = len(words) if inner.weak and inner.away and not beside else 0
                self.lines.append(Line("" if apart else words, self.open[-1], 2 * self.linked > self.total, hidden))
            self.text.clear()
        self.linked = self.total = 0

    def close(self, to: int) -> None:
        """Elements from place ``to`` on end."""
        while len(self.open) > to:
            element = self.elements[self.open.pop()]
            element.last = len(self.elements) - 1
            self.at[element.tag].pop()
            if self.blocks_open and self.blocks_open[-1] == len(self.open):
                self.blocks_open.pop()

    def begin(self, tag: str, attributes: str) -> None:
        around = self.elements[self.open[-1]]
        main = tag in ("article", "main") or 'role="main"' in attributes or 'itemprop="articleBody"' in attributes
        self.at[tag].append(len(self.open))
        if tag in BLOCK:
            self.blocks_open.append(len(self.open))
        number = len(self.elements)
        mark = "" if number in self.spared else set_apart(tag, attributes, around.in_main, self.marked)
        weak = around.weak or (number if mark == "weak" and not around.away else 0)
        if mark == "strong":
            weak = 0
        header = around.header or tag == "header"
        element = Element(
            tag, self.open[-1], main, main or around.in_main, bool(around.away or mark), header, around.heading or tag in HEADINGS or (header and tag == "p"),
            around.told or (header and byline(tag, attributes)), weak,
        )
        self.open.append(len(self.elements))
        self.elements.append(element)

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        self.linking = False
        unclosed: set[str] = set()
        while at < end:
            found = TAG.search(html, at)
            piece = html[at : found.start()] if found else html[at:]
            if piece and self.elements[self.open[-1]].tag not in CONTROLS:
                self.text.append(unescape(piece))
                self.total += len(piece)
                if self.linking:
                    self.linked += len(piece)
            if not found:
                break
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            closing = (found[1] or found[4]) == "/"
            attributes = found[3] or found[6] or ""
            if tag == "br":
                self.text.append(" ")
            if tag == "a":
                self.linking = not closing and found.start() in self.links and "name" not in attributes.split("=")[0].lower()
            if tag in BLOCK:
                self.flush()
            if closing:
                if self.at[tag]:
                    self.close(self.at[tag][-1])
                continue
            if tag in RAW:
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
                ends = html.find(">", close.end()) if close else -1
                if ends < 0:
                    unclosed.add(tag)
                at = ends + 1 if ends >= 0 else (end if tag in SWALLOWS else at)
                continue
            if tag in BLOCK:
                ended = self.at[ENDS_ITSELF[tag]] if tag in ENDS_ITSELF else []
                if ended and ended[-1] >= len(self.open) - 3:
                    self.close(ended[-1])
                # an open paragraph ends where a block begins, with what was left open in it
                if self.blocks_open and self.elements[self.open[self.blocks_open[-1]]].tag == "p":
                    self.close(self.blocks_open[-1])
            if tag in VOID or attributes.endswith("/"):
                continue
            self.begin(tag, attributes)


def core(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """First and last-but-one line of the stretch from a surge to the next dive that has
    the most text. Window sums surge to ``surge`` or, if none is so large, to the largest."""
    before = [0, *accumulate(lengths)]
    n = len(lengths)
    sums = [before[min(n, i + window)] - before[i] for i in range(n)]
    least = max(1, min(surge, max(sums, default=0)))
    best, i = (0, 0, 0), 0
    while i < n:
        if sums[i] < least:
            i += 1
            continue
        begin = i
        while i < n and sums[i] >= least:
            i += 1
        end = min(n, i + window - 1)
        total = before[end] - before[begin]
        if total > best[0]:
            best = (total, begin, end)
    begin, end = best[1:]
    while begin < end and not lengths[begin]:
        begin += 1
    while end > begin and not lengths[end - 1]:
        end -= 1
    return begin, end


def main_text(html: str) -> str:
    """The blocks of the main text, joined by an empty line. Where the class or id of
    what is around an article sets all of it apart, it is not believed."""
    page = unveiled(html or "")
    return text_of(page) or text_of(Page(html or "", marked=False), articles=True)


def unveiled(html: str) -> Page:
    """The page, without the weak marks that set its running text apart. They are looked for
    from outside to inside, once for each that is nested."""
    page, spared = Page(html), frozenset()
    while True:
        lengths = lengths_of(page)
        begin, end = core(lengths)
        if sum(lengths[begin:end]) >= SURGE:
            return page
        hidden = [line.hidden for line in page.lines]
        begin, end = core(hidden)
        total = sum(hidden[begin:end])
        held: dict[int, list[int]] = defaultdict(list)
        for line in page.lines[begin:end]:
            if line.hidden:
                held[page.elements[line.element].weak].append(line.hidden)
        holder = max(held, key=lambda e: sum(held[e]), default=0)
        # running text: more than one block, and most of what there is
        if total < SURGE or len(held[holder]) < 2 or sum(held[holder]) < HOLDS * total:
            return page
        spared |= {holder}
        page = Page(html, spared=spared)


def lengths_of(page: Page) -> list[int]:
    """Of each line; outside of articles, lines of links are menus."""
    return [0 if line.linked and not page.elements[line.element].in_main else len(line.text) for line in page.lines]


def text_of(page: Page, articles: bool = False) -> str:
    """The main text of a page; only that of articles, if so asked."""
    lines, elements = page.lines, page.elements
    lengths = lengths_of(page)
    begin, end = core(lengths)
    if begin == end:
        return ""
    # how much of the core an element holds, and how many lines
    weight, count = [0] * len(elements), [0] * len(elements)
    for i, line in enumerate(lines):
        count[line.element] += bool(line.text)
        if begin <= i < end:
            weight[line.element] += lengths[i]
    heaviest = [0] * len(elements)
    for e in range(len(elements) - 1, 0, -1):
        up = elements[e].parent
        weight[up] += weight[e]
        count[up] += count[e]
        if not heaviest[up] or weight[e] >= weight[heaviest[up]]:
            heaviest[up] = e
    whole, holder, article = weight[0], 0, 0
    step = heaviest[0]
    while step and weight[step] >= HOLDS * whole:
        if elements[step].main and weight[step] >= (HOLDS_WITHIN if article else HOLDS) * whole:
            article = step
        if count[step] > 1:
            holder = step
        step = heaviest[step]
    if articles and not article:
        return ""
    holder = article or holder
    last = elements[holder].last
    kept = []
    for i, line in enumerate(lines):
        # before the element, a headline or a lead of the core; the sums begin to surge a few lines too soon
        leads = begin <= i < end and line.element < holder and lengths[i] and (elements[line.element].heading or lengths[i] * WINDOW >= SURGE)
        if line.text and (holder <= line.element <= last or leads):
            kept.append(line.text)
    return "\n\n".join(kept)


def extract(batches: Iterator[pa.RecordBatch], carried: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html or "") for html in batch.column(carried).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(carried)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*batch.schema.names[:carried], "__html_text", "__html_chars"],
        )


def extract_text(pages: DataFrame, carry: list[str], *, html: str = "html") -> DataFrame:
    """Columns ``carry`` of every row, with ``__html_text`` and ``__html_chars``.

    Null and empty pages give an empty text, as do pages of nothing but markup and
    menus. Of stretches with equally much text, the first is the core. Whole pages are
    read, in time that grows with their length. Rows are independent: nothing is
    shuffled, repeated rows repeat, and an empty table gives an empty result.
    Columns of ``pages`` beside ``carry`` are not read; names that begin with
    ``__html_`` are reserved.
    """
    ship(pages.sparkSession)
    rows = pages.select(*[F.col(c) for c in carry], F.col(html).alias("__html_source"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*carry).schema.fields)
    return rows.mapInArrow(lambda it: extract(it, len(carry)), f"{fields}, __html_text string, __html_chars long")
