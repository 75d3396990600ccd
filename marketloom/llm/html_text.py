"""Main text of HTML pages: parser events, text-to-tag ratio by line, smoothing and a threshold.

The standard library's parser streams through the page; block-level tags end a line, and each line keeps its text,
the number of tags in it and the element that it stands in. Lines in elements that never hold an article (menus, headers
outside an article, footers, sidebars, forms, notices, adverts, comments, scripts, styles, hidden parts) are furniture and
count as zero. The ratio of text to tags is smoothed over neighbouring lines by a Gaussian kernel, and a threshold, found
by two-means clustering of the page's smoothed ratios, selects content lines. They decide the region on every page:

* where marked elements (<article>, <main>, role=main) hold at least half of the content lines' text, the regions are the
  outermost marked elements with a content line in them that is not only lifted by its neighbours; marks without one (teasers, cards) are left out;
* otherwise the region is the innermost element that holds nine tenths of the content lines' text, widened to its ancestors
  while they add mostly content lines or headings, and to content lines and a heading beside it;
* where only the body holds them, the content lines stay, with the short lines between two of them.

A region keeps all its lines that are not furniture, short ones included, and nothing outside.

Class, id and role mark furniture by whole names, compounds of such words with neutral ones included (cookie-notice,
site-header), but not headings nor headers inside an article. A form or named element that holds over half of
the article text and began before the article, or over half of the text of a page without such a mark, is layout.

Character references are decoded, white space in a block becomes one space, blocks are joined by a
line feed. Null and empty pages, and pages without text, give an empty text. Malformed pages never fail: unknown declarations
are comments, an unclosed comment runs to the page's end, a head ends where content begins, list items, cells, rows and terms end where the
next begins, other unclosed tags end with their parent. Time and memory follow the page's length. Repeated rows are
extracted independently.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import map_arrow, slices, strings

SIGMA = 1.0

#: Characters of a line that can be prose beside a region.
SENTENCE = 40

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math canvas iframe object audio video head title select option textarea button datalist".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words in class, id or role that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related respond sharing share sidebar signup social sponsor sponsored subscribe toolbar widget navigation contentinfo complementary search alert reply replies".split()
)
#: Words that don't change what a name marks.
NEUTRAL_WORDS = frozenset("area bar block box button buttons container content global inner item items left link links list main outer page right section site top bottom wrap wrapper".split())
#: Names of what readers wrote, which may be longer than the page's own text.
READERS = frozenset("comment comments disqus respond reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a head may hold; anything else ends it.
HEAD_TAGS = frozenset("head title meta link script style base noscript template".split())
#: The family that a tag belongs to, and the families whose open elements a tag hides.
FAMILIES = {"p": 0, "li": 1, "td": 2, "th": 2, "tr": 3, "dt": 4, "dd": 4}
HIDES = {
    **dict.fromkeys("article main div section body button".split(), (0,)),
    **dict.fromkeys("ul ol menu".split(), (1,)),
    "li": (0,),
    "dl": (4,),
    "td": (0,),
    "table": (1, 2, 3, 4),
}
OWN_FAMILIES = {t: (HIDES.get(t, ()), FAMILIES.get(t)) for t in HIDES.keys() | FAMILIES.keys()}
#: The families whose open element a tag ends.
ENDS = {"li": (0, 1), "td": (0, 2), "th": (0, 2), "tr": (0, 2, 3), "dt": (0, 4), "dd": (0, 4), **dict.fromkeys(BLOCK - {"br"} - {"li", "td", "th", "tr", "dt", "dd"}, (0,))}

class Element:
    """An open or closed element. parent, article (the innermost article or main around it, itself included), mark (the
    outermost) and soft (the innermost form or element named as furniture) are numbers of elements, 0 for none; open holds the
    open element of each family that ends by itself; lines first to end stand in it."""

    __slots__ = ("tag", "parent", "silent", "furniture", "article", "mark", "soft", "open", "first", "end")

    def __init__(self, tag: str, parent: int, silent: bool, furniture: bool, article: int, mark: int, soft: int, open: tuple[int, ...], first: int) -> None:  # noqa: A002
        self.tag, self.parent, self.silent, self.furniture, self.article, self.mark, self.soft, self.open, self.first = tag, parent, silent, furniture, article, mark, soft, open, first
        self.end = -1


class Line:
    """element: the innermost element that the line stands in; heading: it, its parent or the next is a heading."""

    __slots__ = ("text", "tags", "element", "furniture", "article", "mark", "heading")

    def __init__(self, text: str, tags: int, number: int, own: Element, heading: bool) -> None:
        self.text, self.tags, self.element, self.furniture, self.article, self.mark, self.heading = text, tags, number, own.furniture, own.article, own.mark, heading


@lru_cache(maxsize=65_536)
def marks_furniture(name: str) -> bool:
    parts = set(re.findall("[a-z]+", name))
    return not parts.isdisjoint(FURNITURE_WORDS) and parts <= FURNITURE_WORDS | NEUTRAL_WORDS


class LineParser(HTMLParser):
    """Turns parser events into elements, each with its parent, and lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.elements = [Element("", 0, False, False, 0, 0, 0, (0,) * 5, 0)]
        self.stack = [0]
        self.open_tags: dict[str, int] = {}
        self.forms: set[int] = set()
        self.readers: set[int] = set()
        self.parts: list[str] = []
        self.tags = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # as browsers do; the library knows few kinds and stops at others

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = re.compile("--!?>").search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            number = self.stack[-1]
            self.lines.append(Line(text, self.tags, number, self.elements[number], any(self.elements[k].tag in HEADINGS for k in self.stack[-3:])))
            self.tags = 0
        self.parts = []

    def close_from(self, depth: int) -> None:
        """Elements from that place of the stack on end."""
        for number in self.stack[depth:]:
            own = self.elements[number]
            own.end = len(self.lines)
            self.open_tags[own.tag] -= 1
        del self.stack[depth:]

    def close_number(self, number: int) -> None:
        depth = len(self.stack) - 1
        while self.stack[depth] != number:
            depth -= 1
        self.close_from(depth)

    def leave_head(self) -> None:
        if self.open_tags.get("head"):
            self.close_tag("head")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag not in HEAD_TAGS:
            self.leave_head()
        for family in ENDS.get(tag, ()):  # a paragraph ends where another block begins, a list item where the next does
            if number := self.elements[self.stack[-1]].open[family]:
                self.close_number(number)
        if tag in VOID:
            return
        parent = self.stack[-1]
        around = self.elements[parent]
        number = len(self.elements)
        silent = around.silent or tag in SILENT
        main = tag in ("article", "main")
        furniture = around.furniture or (tag in FURNITURE and tag != "form") or (tag == "header" and not around.article)
        soft = around.soft
        if tag == "form":
            self.forms.add(number)
            soft = number
        if attrs:
            own = dict(attrs)
            names = " ".join(own.get(k) or "" for k in ("class", "id", "role")).lower().split()
            free = tag in ("html", "body", "article", "main") or tag in HEADINGS or (tag == "header" and around.article)
            named = [] if free else [x for x in names if marks_furniture(x)]
            if named:
                soft = number
                if any(not READERS.isdisjoint(re.findall("[a-z]+", x)) for x in named):
                    self.readers.add(number)
            main = main or own.get("role") == "main"
            silent = silent or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in (own.get("style") or "").replace(" ", "")
            furniture = furniture or bool(tag == "article" and (around.article or around.soft) and any("comment" in re.findall("[a-z]+", x) for x in names))
        inside = around.open
        if tag in OWN_FAMILIES:
            hidden, family = OWN_FAMILIES[tag]
            inside = tuple([number if k == family else 0 if k in hidden else x for k, x in enumerate(inside)])
        mark = around.mark or (number if main else 0)
        self.elements.append(Element(tag, parent, silent, furniture, number if main else around.article, mark, soft, inside, len(self.lines)))
        self.stack.append(number)
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def close_tag(self, tag: str) -> None:
        if tag in FAMILIES:
            if number := self.elements[self.stack[-1]].open[FAMILIES[tag]]:
                self.close_number(number)
        elif self.open_tags.get(tag):
            depth = len(self.stack) - 1
            while self.elements[self.stack[depth]].tag != tag:
                depth -= 1
            self.close_from(depth)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag not in VOID:
            self.close_tag(tag)

    def handle_data(self, data: str) -> None:
        if self.open_tags.get("head") and self.elements[self.stack[-1]].tag == "head" and data.strip():
            self.leave_head()
        if not self.elements[self.stack[-1]].silent:
            self.parts.append(data)


def parsed(html: str) -> LineParser:
    parser = LineParser()
    end = html.rfind(">") + 1
    parser.feed(html[:end])
    parser.close()
    if not parser.cdata_elem:  # no tag ends after the last >: what is left is text, up to a tag that is cut off
        parser.handle_data(unescape(re.split("<(?=[a-zA-Z/!?])", html[end:], maxsplit=1)[0]))
    parser.end_line()
    parser.close_from(1)
    settle(parser)
    return parser


def lines_of(html: str) -> list[Line]:
    return parsed(html).lines


def settle(parser: LineParser) -> None:
    """Lines in forms and named elements become furniture, unless the element is layout."""
    elements, lines = parser.elements, parser.lines
    if not any(elements[x.element].soft for x in lines):
        return
    from_readers = [False] * len(elements)  # the element stands in what readers wrote
    for k in range(1, len(elements)):
        from_readers[k] = from_readers[elements[k].parent] or k in parser.readers
    plain = [x for x in lines if not x.furniture]
    marked = [x for x in plain if x.article and not from_readers[x.element]]
    # characters of the lines that stand in a form or named element, and of those whose article began inside it
    inside, before = [0] * len(elements), [0] * len(elements)
    for x in marked or plain:
        inside[elements[x.element].soft] += len(x.text)
        if x.article:
            before[elements[elements[x.article].parent].soft] += len(x.text)
    above = [0] * len(elements)
    for k in range(len(elements) - 1, 0, -1):
        if elements[k].soft == k:
            above[k] = elements[elements[k].parent].soft
            inside[above[k]] += inside[k]
            before[above[k]] += before[k]
    half = sum(len(x.text) for x in marked or plain) / 2
    thrown = [False] * len(elements)
    for k in range(1, len(elements)):
        if elements[k].soft == k:
            held = 0 if k in parser.readers else inside[k] if not marked or k in parser.forms else before[k]
            thrown[k] = held <= half or thrown[above[k]]
    for x in plain:
        x.furniture = thrown[elements[x.element].soft]


def smoothed_ratios(lines: list[Line], sigma: float = SIGMA) -> np.ndarray:
    """Text-to-tag ratio of each line, smoothed by a Gaussian kernel."""
    ratio = np.array([0.0 if x.furniture else len(x.text) / max(1, x.tags) for x in lines])
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(ratios: np.ndarray) -> float:
    """Half-way between the centres of two clusters of log ratios."""
    x = np.log1p(ratios)
    lo, hi = float(x.min()), float(x.max())
    for _ in range(50):
        cut = (lo + hi) / 2
        below, above = x[x <= cut], x[x > cut]
        if not len(below) or not len(above):
            break
        if (new := (float(below.mean()), float(above.mean()))) == (lo, hi):
            break
        lo, hi = new
    return float(min(np.expm1((lo + hi) / 2), ratios.max()))  # rounding must not lift it over lines that are all alike


def container(elements: list[Element], lines: list[Line], high: list[bool], share: float = 0.9) -> int | None:
    """The innermost element that holds at least `share` of the content lines' text, if there is one inside the body."""
    weight = [0] * len(elements)
    for x, h in zip(lines, high, strict=True):
        if h:
            weight[x.element] += len(x.text)
    total = sum(weight)
    for k in range(len(elements) - 1, 0, -1):  # children have higher numbers, so the first that is met is the innermost
        if weight[k] >= share * total:
            return None if elements[k].tag in ("html", "body") else k
        weight[elements[k].parent] += weight[k]
    return None


def widened(elements: list[Element], lines: list[Line], high: list[bool], strong: list[bool], region: int) -> list[int]:
    """The lines to keep around a region: those of its ancestors while these add mostly content lines or headings,
    then content lines at most three lines off, and a heading right before."""
    lo, hi = elements[region].first, elements[region].end
    parent = elements[region].parent
    while parent and elements[parent].tag not in ("html", "body"):
        wide = elements[parent]
        added = [i for i in (*range(wide.first, lo), *range(hi, wide.end)) if not lines[i].furniture]
        good = sum(len(lines[i].text) for i in added if high[i] or lines[i].heading)
        if added and 2 * good < sum(len(lines[i].text) for i in added):
            break
        lo, hi, parent = wide.first, wide.end, wide.parent
    hi -= 1
    while (near := [i for i in range(max(0, lo - 3), lo) if strong[i]]):
        lo = near[0]
    while (near := [i for i in range(hi + 1, min(len(lines), hi + 4)) if strong[i]]):
        hi = near[-1]
    if lo and lines[lo - 1].heading and not lines[lo - 1].furniture:
        lo -= 1
    return [i for i in range(lo, hi + 1) if not lines[i].furniture]


def content_lines(lines: list[Line], sigma: float = SIGMA) -> tuple[list[bool], float]:
    """Which lines the smoothed ratios and their threshold select, and the threshold."""
    ratios = smoothed_ratios(lines, sigma)
    cut = threshold(ratios)
    return [r >= cut and not x.furniture for x, r in zip(lines, ratios.tolist(), strict=True)], cut


def region_lines(parser: LineParser, sigma: float = SIGMA) -> list[int]:
    """The lines of the page's content regions."""
    lines, elements = parser.lines, parser.elements
    high, cut = content_lines(lines, sigma)
    # a line that its neighbours lift over the threshold does not speak for its mark
    marks = {x.mark for x, h in zip(lines, high, strict=True) if h and x.mark and len(x.text) >= cut * max(1, x.tags)}
    total = sum(len(x.text) for x, h in zip(lines, high, strict=True) if h)
    if marks and 2 * sum(len(x.text) for x, h in zip(lines, high, strict=True) if h and x.mark) >= total:
        return [i for i, x in enumerate(lines) if x.mark in marks and not x.furniture]
    if (region := container(elements, lines, high)) is not None and sum(high) > 1:
        strong = [h and len(x.text) >= SENTENCE for x, h in zip(lines, high, strict=True)]
        return widened(elements, lines, high, strong, region)
    places = [i for i, h in enumerate(high) if h]
    # short lines between two content lines of one region stay
    near = {j for a, b in zip(places, places[1:], strict=False) if b - a <= 3 for j in range(a, b)} | set(places)
    return [i for i in sorted(near) if not lines[i].furniture]


def main_text(html: str, sigma: float = SIGMA) -> str:
    parser = parsed(html)
    return "\n".join([parser.lines[i].text for i in region_lines(parser, sigma)]) if parser.lines else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep`, text string and n_chars long for every row."""
    kept = pages.select(*keep, F.col(html).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [main_text(h) for h in strings(part.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return map_arrow(kept, run, ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + ", text string, n_chars long")
