"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. Block elements cut the page into lines; each line has its text, the
number of tags around it, and the containers that it stands in. Lines inside elements that are never main text (menus,
footers, forms, scripts, adverts, notices, reader comments) have no weight. The ratios of text to tags are smoothed
over neighbouring lines, a threshold between two clusters parts content from the rest. The content region is the article
that holds most of the text, else the innermost container that holds all content, or the article or main around it.
Without either, headings and paragraphs beside the region belong to it too, where they aren't mostly links or scraps. Its
lines are the result, in page order.

Within an article or main, a name drops a part for certain only if all of it is the name of a page part; other names make
it doubtful, and it goes if it is mostly links, has controls of a form, or ends the article in short lines.

Defined results: null or empty html gives empty text; broken markup is read as far as it goes, with elements closed by
their parents, marked sections (<![...) skipped, a comment without end closed by the next >, and a tag without end at the
end of the page left out; character references are decoded; white space in a block becomes one space, a line break too. Equal rows
give equal results; rows are never joined; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element names of HTML and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("script style noscript template head title nav aside footer form button select option textarea iframe object svg canvas audio video dialog menu".split())
CONTAINERS = frozenset("article main section div body html".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names that tell a page part, alone or as the first or last part of a longer name ("site-footer", "ad-slot").
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead cookie cookies consent gdpr popup modal newsletter subscribe signup login comment comments commentlist disqus pagination pager".split()
)
#: Names that tell a page part alone, or beside one of the companions; "related-work" is a section of an article.
WEAK_NAMES = frozenset("aside notice notices alert overlay promotion subscription share sharing social related recommended discussion replies respond widget toolbar skip review reviews rating ratings feedback testimonials disclaimer".split())
COMPANIONS = frozenset("area bar block box button buttons content contents form icons item items link links list more page pages post posts section site stories story strip text this top wrapper slot unit wrap container left right bottom inner outer main user users reader readers customer".split())
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that what stands inside them can't close.
BARRIERS = frozenset("article main section div body html ul ol table dl blockquote nav aside header footer form".split())
#: Elements whose text is an article's own, wherever they stand.
PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption".split())
CONTROLS = frozenset("form input button select textarea".split())
SIGMA = 2.0
#: Shares of a text that is links: a doubtful part has more, what stands beside the content region less. Lines of a doubtful part
#: at an article's end are shorter than this on the whole.
LINKED, SHORT_LINE = 0.4, 40
#: Paragraphs beside the content region have this length on the whole, if there is no heading with them.
SENTENCE = 20
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
#: Elements whose content belongs together: the content region is not a part of one.
WHOLES = frozenset(("article", "main"))


def names_a_page_part(names: str) -> bool:
    """Whether one of the names in a class or id attribute is that of a menu, advert, notice, comment list and so on."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if name in DROPPED_NAMES or name in WEAK_NAMES or parts and (parts[0] in DROPPED_NAMES or parts[-1] in DROPPED_NAMES):
            return True
        if len(parts) > 1 and WEAK_NAMES.intersection(parts) and all(p in WEAK_NAMES or p in COMPANIONS for p in parts):
            return True
    return False


def surely_a_page_part(names: str) -> bool:
    """Whether one of the names is made of names of page parts and their companions alone: not "comment-on-method"."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if name in DROPPED_NAMES or DROPPED_NAMES.intersection(parts) and all(p in DROPPED_NAMES or p in COMPANIONS for p in parts):
            return True
    return False


@dataclass
class Container:
    """An element that may be the content region; containers are numbered as they open, so one holds all numbers from
    its own to its last."""

    parent: int
    name: str
    last: int = 0


@dataclass
class Line:
    text: str
    tags: int
    container: int
    linked: int  # characters within links
    own: bool  # in a heading or paragraph
    heading: bool
    doubt: int  # number of the doubtful part that it is in, 0 for none


class Lines(HTMLParser):
    """Collects the lines of weight. Every event takes constant time on average: open elements are found by name, containers
    know their parents, and what has no end isn't looked for again and again."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # name, dropped, number of the innermost container, of the doubtful part
        self.places: dict[str, list[int]] = {}  # name -> where in open
        self.barriers: list[int] = []
        self.containers = [Container(0, "")]  # number 0 is the page
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.controls = [False]  # for each doubtful part, whether it has any
        self.last_end = -1

    def read(self, page: str) -> None:
        """All of a page. A tag that has no end at the end of the page is left out, as are those after it."""
        whole = page.rfind(">") + 1
        rest = UNFINISHED.search(page, whole)
        page = page[: rest.start()] if rest else page
        self.size = len(page)
        self.last_end = page.rfind("--")  # of a comment
        self.feed(page)
        self.close()
        self.cut()
        self.close_from(0)
        self.containers[0].last = len(self.containers) - 1

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment without end is closed by the next >."""
        from_end = len(self.rawdata) - i  # what is fed stays whole until it is read to the end
        end = super().parse_comment(i, report) if self.size - from_end + 4 <= self.last_end else -1
        return end if end >= 0 else self.rawdata.find(">", i) + 1 or -1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A section in brackets, of whatever name, ends at the next >; it isn't text."""
        at = self.rawdata.find(">", i + 3)
        return at + 1 if at >= 0 else -1

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, _, number, doubt = self.open[-1] if self.open else ("", False, 0, 0)
            own = any(self.places.get(name) for name in PARAGRAPHS)
            heading = own and any(self.places.get(name) for name in HEADINGS)
            self.lines.append(Line(text, self.tags, number, self.linked, own, heading, doubt))
        if text or self.tags > 50:
            self.tags = 0
        self.text, self.linked = [], 0

    def in_whole(self) -> bool:
        return any(self.places.get(name) for name in WHOLES)

    def is_dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED or tag == "header" and not self.in_whole():
            return True
        if tag in ("html", "body", "main", "article"):
            return False
        for k, v in attrs:
            if k in ("class", "id") and v and (surely_a_page_part(v) if self.in_whole() else names_a_page_part(v)):
                return True
            if k == "role" and v and v.lower() in DROPPED_ROLES or k == "hidden" or k == "aria-hidden" and v == "true":
                return True
            if k == "style" and v and re.search(r"display\s*:\s*none", v.lower()):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self.cut()
        if tag in SELF_CLOSING:
            self.close_open(SELF_CLOSING[tag])
        elif tag not in INLINE and tag not in VOID:
            self.close_open(("p",))  # a block ends a paragraph
        _, dropped, number, doubt = self.open[-1] if self.open else ("", False, 0, 0)
        if tag in CONTROLS:
            self.controls[doubt] = True
        if tag in VOID:
            return
        dropped = dropped or self.is_dropped(tag, attrs)
        if not dropped and not doubt and tag not in WHOLES and self.in_whole() and any(k in ("class", "id") and v and names_a_page_part(v) for k, v in attrs):
            self.controls.append(False)
            doubt = len(self.controls) - 1
        if tag in CONTAINERS:
            self.containers.append(Container(number, tag))
            number = len(self.containers) - 1
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BARRIERS:
            self.barriers.append(len(self.open))
        self.open.append((tag, dropped, number, doubt))

    def close_from(self, place: int) -> None:
        """Close the open elements from a place on."""
        while len(self.open) > place:
            name, _, number, _ = self.open.pop()
            self.places[name].pop()
            if name in BARRIERS:
                self.barriers.pop()
            if name in CONTAINERS:
                self.containers[number].last = len(self.containers) - 1

    def close_open(self, names: tuple[str, ...]) -> None:
        """Close the innermost open element of these names and what is in it, unless a barrier stands between."""
        place = max((self.places[name][-1] for name in names if self.places.get(name)), default=-1)
        if place > (self.barriers[-1] if self.barriers else -1):
            self.close_from(place)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.cut()
        if self.places.get(tag):
            self.close_from(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.text.append(data)
            if self.places.get("a"):
                self.linked += len(data.strip())

    def without_doubtful(self) -> list[Line]:
        """The lines but those of doubtful parts that more than their names tells against."""
        members: dict[int, list[Line]] = {}
        for line in self.lines:
            members.setdefault(line.doubt, []).append(line)
        certain, ended = {i: line.container for i, line in enumerate(self.lines) if not line.doubt}, set()
        for line in reversed(self.lines):  # parts with no certain line after them
            if not line.doubt:
                break
            ended.add(line.doubt)
        if not certain:
            return self.lines
        gone = set()
        for doubt, lines in members.items():
            chars = sum(len(x.text) for x in lines)
            if doubt and (self.controls[doubt] or sum(x.linked for x in lines) > LINKED * chars or doubt in ended and chars < SHORT_LINE * len(lines)):
                gone.add(doubt)
        return [line for line in self.lines if line.doubt not in gone]


def content_threshold(ratios: np.ndarray) -> float:
    """Halfway between the means of the low and the high cluster, found by turns."""
    t = float(ratios.mean())
    for _ in range(50):
        low, high = ratios[ratios <= t], ratios[ratios > t]
        if not len(low) or not len(high):
            break
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def holds(containers: list[Container], number: int, line: Line) -> bool:
    return number <= line.container <= containers[number].last


def leading_article(lines: list[Line], containers: list[Container]) -> int | None:
    """The outermost article that holds more than half of all text, if one does."""
    weight = np.zeros(len(containers) + 1)
    np.add.at(weight, [x.container for x in lines], [len(x.text) for x in lines])
    before = np.concatenate([[0.0], np.cumsum(weight)])
    for number, c in enumerate(containers):
        if c.name == "article" and before[c.last + 1] - before[number] > before[-1] / 2:
            return number
    return None


def with_neighbours(lines: list[Line], containers: list[Container], region: int) -> list[Line]:
    """The region's lines, and headings and paragraphs beside it, by the containers they stand in, where these aren't mostly links or scraps."""
    chosen = {id(x) for x in lines if holds(containers, region, x)}
    inside = region
    while inside:
        around = containers[inside].parent
        beside: dict[int, list[Line]] = {}
        for line in lines:
            if holds(containers, around, line) and not holds(containers, inside, line):
                top = line.container
                while top != around and containers[top].parent != around:
                    top = containers[top].parent
                beside.setdefault(top, []).append(line)
        for part in beside.values():
            own = [x for x in part if x.own]
            told = any(x.heading for x in own) or sum(len(x.text) for x in own) >= SENTENCE * len(own)
            if told and sum(x.linked for x in part) <= LINKED * sum(len(x.text) for x in part):
                chosen.update(map(id, own))
        inside = around
    return [x for x in lines if id(x) in chosen]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.read(html)
    lines, containers = parser.without_doubtful(), parser.containers
    if not lines:
        return ""
    region = leading_article(lines, containers)
    if region is None:
        lengths = np.array([len(x.text) for x in lines], dtype=float)
        ratios = smooth(lengths / np.maximum(1.0, [x.tags for x in lines]))
        content = ratios >= min(content_threshold(ratios), float(ratios.max()))
        numbers = np.array([x.container for x in lines])
        first, last = int(numbers[content].min()), int(numbers[content].max())
        region = first
        while containers[region].last < last:  # the innermost container of all content lines
            region = containers[region].parent
        above, whole = region, 0
        while above:
            if containers[above].name in WHOLES:
                whole = above
            above = containers[above].parent
        if not whole:
            return "\n".join(x.text for x in with_neighbours(lines, containers, region))
        region = whole
    return "\n".join(x.text for x in lines if holds(containers, region, x))


def extracted(html: Column) -> Column:
    """The main text of html, a string column."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(x) for x in pages], dtype=object)

    return run(html)
