"""Main text of web pages.

The standard library's parser streams events; text between block boundaries is a line. Each line has a ratio of text to
tags. Ratios are smoothed with a Gaussian along the page and split into two clusters; lines of the upper cluster are the
seeds that say where the content is. The region is the article or main element that holds most seeds. Without one it is the
innermost container of most seeds, widened while an outer container adds seeds or text of its own. Every line of the region
stays, whatever its own ratio, so that short paragraphs do, unless it is part of a menu, header, footer, sidebar, notice,
advert, form, script, style or the readers' comments. Names that may mean one of these or a part of the article (a section
called discussion) are judged by the ratio: seeds stay.

Of several articles on a page, the one with most seeds is the page's. All steps are linear in the page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import map_arrow, texts_of

# Fixed values of HTML: elements without an end tag, elements that begin and end a block, elements that contain blocks,
# elements that are never text, elements that are not part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary"
    " table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 hr pre address".split())
HIDDEN = frozenset(
    "script style noscript template iframe object canvas svg math audio video map datalist head title textarea select"
    " option button frameset noframes".split()
)
APART = frozenset("nav aside footer form menu dialog fieldset search".split())
CLOSED_BY_NEXT = {"li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "tr td th", "option": "option"}
# Words in class, id or role that mark such parts: adverts, parts that are never the article's own, parts that may be.
ADVERTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising advertorial adsense sponsor sponsored promo".split()
)
NAMES = ADVERTS | frozenset(
    "cookie cookies consent gdpr notice alert popup modal newsletter subscribe subscription paywall signup login nav navbar"
    " navigation menu menubar breadcrumb breadcrumbs sidebar sidenav aside widget widgets footer related recommended"
    " recommendations share sharing comment comments commentlist respond replies disqus pager pagination toolbar contentinfo"
    " complementary".split()
)
# Those that mark whatever words they are joined with.
ALWAYS = frozenset(
    "adsense breadcrumb breadcrumbs commentlist disqus gdpr nav navbar newsletter pagination paywall sidebar sidenav".split()
)
NOT = ("has", "no", "with", "without")
UNSURE = frozenset("discussion search social banner overlay promotion reply skip toc tags".split())
# Words that say nothing about the content beside those: `related-posts` marks, `related-work` does not.
PLAIN = frozenset(
    "area article articles bar block bottom box button buttons col column container content entry footer form global group"
    " header heading inner item items js left link links list main message module outer page panel placeholder post posts"
    " primary right row secondary section side site slot small social story stories sub text title top unit wrap wrapper"
    " main sticky mobile desktop large inline the a my".split()
)
# Those of them in which an article is not the page's article, even if one begins there.
ASIDE_NAMES = frozenset(
    "sidebar aside widget widgets related recommended recommendations comment comments commentlist respond replies disqus"
    " discussion".split()
)
HEAD_NAMES = frozenset("header masthead topbar banner".split())
FREE, SOFT, FIRM = range(3)
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")
SIGMA, RADIUS = 1.0, 2
SHARE = 0.7
OUTER = 0.1
# Boxes that are part of a list or table and not a region of their own.
ITEMS = frozenset("ul ol li dl dt dd table tbody thead tfoot tr td th".split())


@dataclass(slots=True)
class Box:
    """An open or closed element that contains blocks; boxes are numbered in the order in which they begin."""

    tag: str
    number: int
    parent: int
    kind: str
    apart: bool
    mark: int
    article: bool
    beside: bool


@dataclass(slots=True)
class Line:
    box: int
    apart: bool
    mark: int
    parts: list[str] = field(default_factory=list)
    tags: int = 1
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


PAGE = Box("", 0, -1, "", False, FREE, False, False)


class Lines(HTMLParser):
    """Collects lines from parser events. Missing and stray end tags are taken as browsers take them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.boxes: list[Box] = [PAGE]
        self.open: list[Box] = [PAGE]
        # Places in `open` of each tag's elements, the innermost last.
        self.places: dict[str, list[int]] = {}
        self.lines: list[Line] = []
        self.hidden: list[str] = []
        self.advert: list[str] = []
        self.links = 0
        self.line = Line(0, False, FREE)

    def new_line(self, mark: int = FREE) -> None:
        if self.line.parts:
            self.lines.append(self.line)
        top = self.open[-1]
        self.advert.clear()
        self.line = Line(top.number, top.apart, max(top.mark, mark))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            if tag == self.hidden[-1] and tag not in VOID:
                self.hidden.append(tag)
            elif tag in ("body", "article", "main") and self.hidden[-1] in ("head", "title"):
                self.hidden.clear()
            else:
                return
        if self.hidden:
            return
        if tag in HIDDEN or (attrs and tag not in VOID and is_hidden(attrs)):
            self.hidden.append(tag)
            if tag in BLOCKS:
                self.new_line()
            return
        if tag in CONTAINERS:
            self.open_box(tag, attrs)
            self.new_line()
        elif tag in BLOCKS:
            self.new_line(mark_of(attrs, NAMES))
        elif tag == "br":
            self.line.parts.append(" ")
        elif tag == "a":
            self.links += 1
        if tag not in BLOCKS and tag not in VOID and (self.advert or (attrs and mark_of(attrs, ADVERTS) == FIRM)):
            self.advert.append(tag)
        self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_from(self, place: int) -> None:
        for box in reversed(self.open[place:]):
            self.places[box.tag].pop()
        del self.open[place:]

    def innermost(self, tags: str) -> int:
        return max((self.places[tag][-1] for tag in tags.split() if self.places.get(tag)), default=0)

    def open_box(self, tag: str, attrs: list) -> None:
        closing = CLOSED_BY_NEXT.get(tag)
        if closing:
            at = self.innermost(closing)
            if at > self.innermost("ul ol dl table menu"):
                self.close_from(at)
        top = self.open[-1]
        apart, mark, article = top.apart, top.mark, top.article
        beside = top.beside or tag == "aside" or mark_of(attrs, ASIDE_NAMES) == FIRM
        own = FREE
        if tag not in ("html", "body", "main"):
            own = mark_of(attrs, NAMES if article else NAMES | HEAD_NAMES)
        if tag in ("article", "main") and own == FREE and not article and not beside:
            # A menu or advert that was never closed.
            apart, mark = False, FREE
        apart = apart or tag in APART or (tag == "header" and not article)
        kind = "main" if tag == "main" or is_main(attrs) else tag
        article = article or (tag == "article" and own == FREE)
        box = Box(tag, len(self.boxes), top.number, kind, apart, max(mark, own), article, beside)
        self.boxes.append(box)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(box)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag == "a" and self.links:
            self.links -= 1
        if tag in self.advert:
            while self.advert.pop() != tag:
                pass
        if tag not in BLOCKS:
            return
        if self.places.get(tag):
            self.close_from(self.places[tag][-1])
        self.new_line()

    def handle_data(self, data: str) -> None:
        if not self.hidden and not self.advert and (self.line.parts or not data.isspace()):
            self.line.parts.append(data)
            if self.links:
                self.line.linked += len(data)


def is_hidden(attrs: list) -> bool:
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def is_main(attrs: list) -> bool:
    return any((name, value) in (("role", "main"), ("itemprop", "articleBody")) for name, value in attrs)


def mark_of(attrs: list, names: frozenset[str]) -> int:
    """What class, id or role say: the element is not content, may be none, or nothing.

    A word of several parts marks if one part does and the others say nothing, such as a prefix of two letters: `ad-slot`
    does, `related-work` does not, nor do `has-sidebar` and `no-ads`.
    """
    found = FREE
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for word in value.split():
                parts = [part for part in SPLIT.split(CAMEL.sub(r"\1-\2", word).lower()) if part]
                others = [part for part in parts if part not in names]
                if parts[:1] and parts[0] in NOT or (len(others) == len(parts) and UNSURE.isdisjoint(parts)):
                    continue
                if not (ALWAYS & names).isdisjoint(parts):
                    return FIRM
                if all(part in PLAIN or part in UNSURE or len(part) <= 2 or part.isdigit() for part in others):
                    found = max(found, FIRM if len(others) < len(parts) else SOFT)
    return found


def smoothed(values: list[float]) -> list[float]:
    """A Gaussian over the neighbours, weights normalised at the ends."""
    kernel = [math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for at in range(len(values)):
        pairs = [(w, values[at + k]) for k, w in zip(range(-RADIUS, RADIUS + 1), kernel) if 0 <= at + k < len(values)]
        out.append(sum(w * v for w, v in pairs) / sum(w for w, _ in pairs))
    return out


def threshold(values: list[float]) -> float:
    """Where two clusters part: the middle of their means, found by alternation. Equal values are one cluster."""
    low, high = min(values), max(values)
    for _ in range(50):
        middle = (low + high) / 2
        upper, lower = [v for v in values if v >= middle], [v for v in values if v < middle]
        if not lower:
            return middle
        now = (sum(lower) / len(lower), sum(upper) / len(upper))
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def seed_weights(lines: list[Line], texts: list[str]) -> list[float]:
    """Characters of the lines of the upper cluster; other lines have none."""
    ratios = [max(0, len(text) - line.linked) / line.tags for line, text in zip(lines, texts)]
    smooth = smoothed(ratios)
    least = threshold(smooth)
    return [len(text) if value >= least and value > 0 else 0.0 for value, text in zip(smooth, texts)]


def held_by(boxes: list[Box], lines: list[Line], weights: list[float]) -> list[float]:
    """The weight of the lines in each box. A box begins behind the one that contains it, so one pass adds up."""
    held = [0.0] * len(boxes)
    for line, weight in zip(lines, weights):
        held[line.box] += weight
    for box in reversed(boxes[1:]):
        held[box.parent] += held[box.number]
    return held


def is_linked(line: Line, text: str) -> bool:
    """Whether most of a line is links."""
    return 2 * line.linked > len(text)


def region(boxes: list[Box], lines: list[Line], texts: list[str], weights: list[float]) -> int:
    """The box that holds the content."""
    held = held_by(boxes, lines, weights)
    total = held[0]
    for kind in ("article", "main"):
        some = [box.number for box in boxes if box.kind == kind and held[box.number] > 0.2 * total]
        if some:
            return max(some, key=lambda number: (held[number], -number))
    inside = max(box.number for box in boxes if held[box.number] >= SHARE * total and box.tag not in ITEMS)
    own = {line.box for line, text in zip(lines, texts) if not is_linked(line, text)}
    beside: dict[int, list[Box]] = {}
    for box in boxes[1:]:
        if held[box.number]:
            beside.setdefault(box.parent, []).append(box)
    best, at = inside, inside
    while at:
        parent = boxes[at].parent
        others = [box for box in beside.get(parent, []) if box.number != at]
        # Beside the whole content, a plain division needs some weight: a slogan is one too.
        outer = boxes[parent].tag in ("", "html", "body")
        if parent in own or any(not outer or box.tag != "div" or held[box.number] >= OUTER * total for box in others):
            best = parent
        at = parent
    return best


def contained(boxes: list[Box], inside: int) -> list[bool]:
    """For each box, whether it is that one or within it."""
    within = [False] * len(boxes)
    for box in boxes:
        within[box.number] = box.number == inside or (box.parent >= 0 and within[box.parent])
    return within


def main_text(html: str) -> str:
    """Blocks of the main text in page order, joined by two line ends; empty if the page has none."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.new_line()
    pairs = [(line, text) for line in parser.lines if (text := line.text())]
    for ignored in (lambda line: line.apart or line.mark == FIRM, lambda line: line.apart):
        kept = [(line, text) for line, text in pairs if not ignored(line)]
        if kept:
            break
    else:
        return ""
    lines, texts = [line for line, _ in kept], [text for _, text in kept]
    weights = seed_weights(lines, texts)
    if not any(weights):
        weights = [float(len(text)) for text in texts]
    boxes = parser.boxes
    inside = region(boxes, lines, texts, weights)
    within = contained(boxes, inside)
    chosen = [k for k, line in enumerate(lines) if within[line.box] and (line.mark < SOFT or weights[k])]
    if boxes[inside].kind not in ("article", "main"):
        # The content begins and ends with the first and last seed, and the lines before and behind them that are not links:
        # of a whole page only a few before, such as a heading.
        seeds = [at for at, k in enumerate(chosen) if weights[k]]
        if seeds:
            first, last = seeds[0], seeds[-1]
            most = RADIUS if boxes[inside].tag in ("", "html", "body") else len(chosen)
            while first and seeds[0] - first < most and not is_linked(lines[chosen[first - 1]], texts[chosen[first - 1]]):
                first -= 1
            while last + 1 < len(chosen) and not is_linked(lines[chosen[last + 1]], texts[chosen[last + 1]]):
                last += 1
            chosen = chosen[first : last + 1]
    return "\n\n".join(texts[k] for k in chosen)


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`page_id`, `url`, `text`, `n_chars`: the main text of each row's whole page and its code points.

    NULL, empty and text-free pages have an empty text. Every row is a page, whatever its id; ids and addresses may
    repeat or be NULL. An empty table gives no rows; other columns are not read.
    """
    rows = df.select(df[page_id].alias("page_id"), df[url].alias("url"), df[html].cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [main_text(page.decode("utf-8", "replace")) for page in texts_of(batch.column("html"))]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts}

    return map_arrow(rows, run, f"page_id {kind}, url string, text string").withColumn(
        "n_chars", F.length("text").cast("bigint")
    )
