"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams its events into lines, one for each block of
the page.  A line has a text-to-tag ratio: characters outside links for each
tag.  The ratios, smoothed with a Gaussian along the page, are clustered in two by a
threshold; lines above it are content.  The content region is the innermost
container that holds all of the content lines, or one further out if that adds
neither blocks set apart nor lists of links; all its lines are the main text, short
ones too, but for blocks that mark themselves as something else (menus, headers,
footers, sidebars, notices, adverts, forms, comments).  Where article or main elements
hold nearly all of the content, these alone are such containers, and if none holds all
content inside them, the region is all of them that hold content or nothing but text.
On a page without such a container every line counts that is neither set apart nor a
list of links.
"""

from __future__ import annotations

import bisect
import operator
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Smoothing of the ratios, in lines.
SIGMA = 1.0
#: Share of the content lines' text that article and main elements hold to be the content region.
HELD = 0.9
#: Share of a page's text beyond which a block is a wrapper, whatever its class or id says; of comments, which may outweigh an article.
WRAPS, COMMENTS_WRAP = 0.5, 0.9

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is no text of the page.
_SILENT = frozenset("script style template noscript iframe object svg math canvas audio video select datalist "
                    "textarea button title head".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu "
                   "nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_REGION = frozenset("article main section div td body".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text; one of them is a list of links only if it is nothing but several links.
_PROSE = _HEADING | {"p", "blockquote", "pre"}
_APART = frozenset("nav aside footer menu dialog".split())
_APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                         "form".split())
#: Words of class and id names that set a block apart from the article.
_APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert modal popup overlay newsletter subscribe subscription paywall sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments commentlist respond replies "
    "reply disqus discussion share sharing social related recommended recommendations widget widgets pagination pager "
    "skip copyright login signup".split())
#: Of these, the words that also name parts of an article; inside one the block's own text decides.
_MAYBE_APART_WORDS = frozenset(
    "notice notices alert modal popup overlay banner promo promotion sidebar menu nav navbar navigation masthead footer "
    "discussion share sharing social related recommended recommendations widget widgets skip copyright".split())
_COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus discussion".split())
#: A block below this share of its article's text-to-tag ratio is far below it.
FAR_BELOW = 1 / 3
_FORM_PARTS = frozenset("form input select textarea button".split())
#: Any other tag, or text, ends a head whose end tag was left out.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: A start tag of the key closes an open one of these, as the end tag may be left out.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}}
_KEEPS_OPEN = frozenset("ul ol dl table".split())


@dataclass(slots=True)
class Line:
    """A block's text in its innermost container; ``lead`` for running text of an article's header."""

    text: str
    tags: int
    link_chars: int
    links_only: bool
    prose: bool
    apart: bool
    region: int
    lead: bool = False


@dataclass(slots=True)
class _Block:
    """Lines ``start`` to ``end``: a container (tag, its outer container) or a block that may set itself apart."""

    tag: str
    outer: int
    start: int
    end: int | None = None
    #: Nearest and outermost article or main, this one included; -1 if none.
    named: int = -1
    top: int = -1


@dataclass(slots=True)
class _Mark(_Block):
    """``kind``: "maybe" (by its own text, inside an article), "word" and "comment" (unless it wraps the page), "form"."""

    kind: str = "maybe"
    form: bool = False


@dataclass(slots=True)
class _Open:
    tag: str
    silent: bool = False
    apart: bool = False
    header: bool = False
    heading: bool = False
    prose: bool = False
    region: int = 0
    mark: _Mark | None = None
    form_parts: int = 0


@dataclass
class _Lines(HTMLParser):
    """Collects lines from parser events.  What a line inherits is carried down the open elements, so
    a tag costs the same at any depth."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = [_Open("")]
        self.count: Counter = Counter()
        self.regions: list[_Block] = [_Block("", -1, 0)]
        self.named: list[_Block] = []
        self.marks: list[_Mark] = []
        self.parts: list[str] = []
        self.tags = self.links = self.link_count = self.in_link = self.form_parts = 0
        self.words = False

    def parse_marked_section(self, i, report=1):
        """A section of unknown kind is no error of the page but a comment up to the next >."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.count["head"]:
            self._end_head(tag)
        if tag in _BLOCK:
            self._flush()
            self._close_implied(tag)
        if tag in _FORM_PARTS:
            self.form_parts += 1
        elif tag == "br" or tag == "hr":
            self.parts.append(" ")
        if tag in _VOID:
            return
        above = self.open[-1]
        home = self.regions[above.region].named
        apart, mark = _is_apart(tag, attrs, home >= 0), None
        if isinstance(apart, str):
            mark = _Mark(tag, home, len(self.lines), kind=apart)
            self.marks.append(mark)
        region = above.region
        if tag in _REGION:
            region = len(self.regions)
            outer = self.regions[above.region]
            block = _Block(tag, above.region, len(self.lines), named=outer.named, top=outer.top)
            if tag in ("article", "main"):
                block.named, block.top = region, outer.top if outer.top >= 0 else region
                self.named += [block] * (outer.top < 0)
            self.regions.append(block)
        self.open.append(_Open(tag, above.silent or tag in _SILENT, above.apart or apart is True, above.header or tag == "header",
                               above.heading or tag in _HEADING, above.prose or tag in _PROSE, region, mark, self.form_parts))
        self.count[tag] += 1
        self.in_link += tag == "a"
        self.link_count += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in _BLOCK:
            self._flush()
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._pop_to(i)
                return
            # A stray inline end tag closes no block.
            if tag not in _BLOCK and self.open[i].tag in _BLOCK:
                return

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._pop_to(len(self.open) - 1)
        if self.open[-1].silent:
            return
        self.parts.append(data)
        if self.in_link:
            self.links += len(data.strip())
        elif not self.words:
            self.words = any(map(str.isalnum, data))

    def finish(self) -> list[Line]:
        self.close()
        self._flush()
        self._pop_to(1)
        self.regions[0].end = len(self.lines)
        self._settle()
        return self.lines

    def _settle(self):
        """Set apart marked blocks by their text, comments before others, inner ones before outer ones; then leads of headers."""
        texts = any(not x.apart and self.regions[x.region].named >= 0 for x in self.lines)
        gone: list[tuple[int, bool, _Mark]] = []
        for comments in (True, False):
            sums = _Sums(self.lines)
            page, inner = sums.of(0, len(self.lines))[0], []
            for mark in sorted((m for m in self.marks if (m.kind == "comment") == comments), key=lambda m: (m.end, -m.start)):
                lost = (0, 0, 0)  # what blocks inside it have lost already
                while inner and inner[-1][0] >= mark.start:
                    lost = tuple(map(operator.add, lost, inner.pop()[1]))
                chars, links, tags = map(operator.sub, sums.of(mark.start, mark.end), lost)
                # Beside an article, what holds none is no wrapper.
                wraps = not texts or mark.outer >= 0 or any(
                    mark.start <= r.start and r.end <= mark.end and r.end > r.start for r in self.named_from(mark.start))
                if not chars:
                    apart = False
                elif mark.kind == "maybe":
                    home = self.regions[mark.outer]
                    around, other_links, other_tags = sums.of(home.start, home.end)
                    far = (chars - links) / max(1, tags) < FAR_BELOW * (around - other_links) / max(1, other_tags)
                    # A block with most of its article's text is no form, though it may have one inside.
                    apart = (mark.form and chars * 2 < around or links * 2 > chars or far) and chars <= WRAPS * page
                else:
                    apart = not wraps or chars <= (COMMENTS_WRAP if comments else WRAPS) * page
                if apart:
                    gone.append((chars, not comments, mark))
                    page -= chars
                    lost = tuple(map(operator.add, lost, (chars, links, tags)))
                inner.append((mark.start, lost))
            cover = np.zeros(len(self.lines) + 1, dtype=np.int64)
            for _, other, mark in gone:
                if other != comments:
                    cover[mark.start] += 1
                    cover[mark.end] -= 1
            for i in np.flatnonzero(np.cumsum(cover[:-1])):
                self.lines[i].apart = True
        if gone and all(x.apart for x in self.lines):
            most = max(gone, key=lambda g: g[:2])[2]  # nothing else is on the page
            for x in self.lines[most.start:most.end]:
                x.apart = False
        ratios: dict[int, float] = {}
        for x in self.lines:
            if x.lead:
                home = self.regions[x.region].named
                if home not in ratios:
                    ratios[home] = _ratio([y for y in self.lines[self.regions[home].start:self.regions[home].end] if not y.apart])
                x.apart = x.apart or _is_links(x) or _ratio([x]) < FAR_BELOW * ratios[home]

    def named_from(self, line: int) -> list[_Block]:
        """The first few outermost articles and mains from a line on: one inside a block begins next."""
        at = bisect.bisect_left(self.named, line, key=lambda r: r.start)
        return self.named[at:at + 3]

    def _end_head(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == "head":
                if tag == "body" or tag not in _IN_HEAD and i == len(self.open) - 1:
                    self._pop_to(i)
                return

    def _close_implied(self, tag):
        ended = {"p"} | _CLOSES.get(tag, set())
        if not any(self.count[t] for t in ended):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in _KEEPS_OPEN or self.open[i].tag in _REGION and self.open[i].tag not in ended:
                return
            if self.open[i].tag in ended:
                self._pop_to(i)
                return

    def _pop_to(self, i):
        for o in self.open[i:]:
            self.count[o.tag] -= 1
            self.in_link -= o.tag == "a"
            if o.tag in _REGION:
                self.regions[o.region].end = len(self.lines)
            if o.mark is not None:
                o.mark.end = len(self.lines)
                o.mark.form = o.mark.kind == "form" or self.form_parts > o.form_parts
        del self.open[i:]

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            here = self.open[-1]
            # Of a header, headings belong to an article, and leads of running text.
            inside = here.header and self.regions[here.region].named >= 0
            lead = inside and not here.heading and here.prose
            self.lines.append(Line(text, self.tags, self.links, self.link_count > 1 and not self.words, here.prose,
                                   here.apart or here.header and not (inside and here.heading or lead), here.region, lead))
            self.tags = 0
        self.parts, self.links, self.link_count, self.words = [], 0, 0, False


class _Sums:
    """Characters, linked characters and tags of the lines not set apart, for any slice."""

    def __init__(self, lines: list[Line]):
        rows = [(0, 0, 0)] + [(0, 0, 0) if x.apart else (len(x.text), min(x.link_chars, len(x.text)), x.tags) for x in lines]
        self.upto = np.cumsum(np.array(rows, dtype=np.int64), axis=0).tolist()

    def of(self, start: int, end: int) -> list[int]:
        return list(map(operator.sub, self.upto[end], self.upto[start]))


def _ratio(lines: list[Line]) -> float:
    """Characters outside links for each tag of all the lines."""
    return sum(max(0, len(x.text) - x.link_chars) for x in lines) / max(1, sum(x.tags for x in lines))


def _is_apart(tag: str, attrs: list[tuple[str, str | None]], in_article: bool = False) -> bool | str:
    """Whether a block sets itself apart, or the kind of mark that its text has to settle."""
    if tag in _APART:
        return True
    mark: bool | str = "form" if tag == "form" else False
    for name, value in attrs:
        if name in ("class", "id") and value and tag not in ("body", "html", "article", "main"):
            words = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            found = _APART_WORDS.intersection(re.split(r"[^a-z]+", words))
            if found and in_article and found <= _MAYBE_APART_WORDS:
                mark = mark or "maybe"
            elif found:
                mark = "comment" if found & _COMMENT_WORDS else "word"
        elif name == "class" and tag == "article" and value and "comment" in value.lower():
            return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "role" and value and value.lower() in _APART_ROLES:
            return True
        elif name == "style" and value and re.search(r"display\s*:\s*none", value):
            return True
    return mark


def page_lines(html: str) -> tuple[list[Line], list[_Block]]:
    """The lines of a page, and its containers in page order; the first one is the page."""
    parser = _Lines()
    parser.feed(html)
    return parser.finish(), parser.regions


def smoothed_ratios(lines: list[Line], sigma: float = SIGMA) -> np.ndarray:
    """Text-to-tag ratio of each line, smoothed along the page; lines set apart count 0."""
    ratio = np.array([0.0 if x.apart else max(0, len(x.text) - x.link_chars) / max(1, x.tags) for x in lines])
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    padded = np.pad(ratio, reach, mode="edge") if len(ratio) else ratio
    return np.convolve(padded, kernel / kernel.sum(), mode="valid") if len(ratio) else ratio


def threshold(values: np.ndarray) -> float:
    """The cut between the two clusters (2-means in one dimension, exact)."""
    v = np.sort(values)
    if len(v) < 2 or v[0] == v[-1]:
        return v[0] if len(v) else 0.0
    n, total = np.arange(1, len(v)), np.cumsum(v)
    low, high = total[:-1] / n, (total[-1] - total[:-1]) / (len(v) - n)
    cut = int(np.argmax(n * (len(v) - n) * (high - low) ** 2))
    return (v[cut] + v[cut + 1]) / 2


def _is_links(line: Line) -> bool:
    """More than half of the line's text is links; of running text, all of it, and several."""
    return line.links_only if line.prose else line.link_chars * 2 > len(line.text)


class _Page:
    """Lines and containers of a page; a container's lines are a slice."""

    def __init__(self, lines: list[Line], regions: list[_Block]):
        self.lines, self.regions = lines, regions
        self.not_plain = np.cumsum([0] + [x.apart or _is_links(x) for x in lines])

    def plain(self, region: int, but: int | None = None) -> bool:
        """Neither blocks set apart nor lists of links in the region, but for an inner one."""
        def count(r):
            return self.not_plain[self.regions[r].end] - self.not_plain[self.regions[r].start]

        return count(region) == (count(but) if but is not None else 0)

    def common(self, content: list[int]) -> int:
        """The innermost container of all these regions: that of the first and the last one in page order."""
        low, high = min(content), max(content)
        while self.regions[low].end < self.regions[high].end or low > high:
            low = self.regions[low].outer
        while low and not self.regions[low].start <= self.regions[high].start <= self.regions[high].end <= self.regions[low].end:
            low = self.regions[low].outer
        return max(low, 0)

    def widest(self, region: int, tags: Collection[str]) -> int:
        """The outermost container of ``tags`` around ``region`` that adds plain lines only."""
        outer = self.regions[region].outer
        while outer > 0:
            if self.regions[outer].tag in tags:
                if not self.plain(outer, region):
                    break
                region = outer
            outer = self.regions[outer].outer
        return region

    def slices(self, regions: Collection[int]) -> list[Line]:
        """Lines of any of the regions, in page order."""
        inside = np.zeros(len(self.lines), dtype=bool)
        for r in regions:
            inside[self.regions[r].start:self.regions[r].end] = True
        return [self.lines[i] for i in np.flatnonzero(inside)]


def main_text(html: str | None) -> str:
    """The article's text; blocks joined by a space.  Empty for null, empty or text-free pages."""
    lines, regions = page_lines(html or "")
    own = [x for x in lines if not x.apart]
    if not own:
        return ""
    page = _Page(lines, regions)
    smooth = smoothed_ratios(lines)
    cut = threshold(smooth)
    content = [x for x, v in zip(lines, smooth) if v >= cut and not x.apart] or own
    # A list of links beside a long paragraph is lifted by it; it does not widen the region.
    content = [x for x in content if not _is_links(x)] or content
    named = [regions[x.region].named for x in content]
    if sum(len(x.text) for x, n in zip(content, named) if n >= 0) >= HELD * sum(len(x.text) for x in content):
        named = [n for n in named if n >= 0]
        whole = regions[page.common(named)].named
        chosen = {page.widest(whole, ("article", "main"))} if whole >= 0 else {regions[n].top for n in named}
        taken = np.cumsum([0] + [0] * len(lines))
        for r in chosen:
            taken[regions[r].start + 1:regions[r].end + 1] = 1
        taken = np.cumsum(taken)
        other = [r for r, x in enumerate(regions) if r and x.tag in ("article", "main") and x.end > x.start
                 and taken[x.end] == taken[x.start] and page.plain(r)]
        return " ".join(x.text for x in page.slices(chosen.union(other)) if not x.apart)
    region = page.widest(page.common([x.region for x in content]), _REGION - {"body"})
    if not region or regions[region].tag == "body":
        inside = [x for x in lines if not _is_links(x)]
    else:
        inside = page.slices([region])
    return " ".join(x.text for x in inside if not x.apart)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars (code points).

    One row per row, whatever the page: null, empty or broken html gives an empty
    text or what can be read; a declaration that cannot be parsed counts as a comment.  Time and memory
    grow with the length of a page, not with its depth.  White space is what `str.split` takes for it.
    Columns named text or n_chars are replaced.  Pages are independent, so
    nothing is shuffled.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*rest, F.col(html_col).alias("_html"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h.as_py()) for h in part.column("_html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in rest] + [pa.array(texts, pa.string()),
                                                      pa.array([len(t) for t in texts], pa.int64())],
                    [*rest, "text", "n_chars"])

    return rows.mapInArrow(work, ", ".join(filter(None, [schema, "text string, n_chars long"])))
