"""Main text of web pages from the standard library's parser events.

Events are cut into lines, one per block of the page. Each line has a text-to-tag ratio; the ratios of the
lines that no page furniture encloses are smoothed by a Gaussian and split at their standard deviation. The
lines above it are content. The smallest element that holds most of their text, or the outermost article or main
element around it, is the content region: all its lines are the page's text, short ones too, but for those inside
furniture. Beside the region, an element with content or headings is text as well unless most of it is links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

SIGMA = 1.0
RADIUS = 2
MOST = 0.6

# Elements by the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td "
    "template textarea tfoot th thead title tr ul".split()
)
FURNITURE = set(
    "aside audio button canvas datalist dialog footer form head header iframe input label menu nav noscript object option script search "
    "select style svg template textarea title video".split()
)
#: Words of a class, id or role that mark what others wrote or sell, which an article element may hold as well.
OTHERS = set(
    "ad ads adv advert adverts advertisement advertising comment comments commentlist disqus promo promotion promoted replies reply respond "
    "sponsor sponsored sponsors".split()
)
#: And those that mark other furniture.
MARKS = OTHERS | set(
    "banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright footer form gdpr header login masthead menu menubar "
    "modal nav navbar navigation newsletter notification pager pagination paywall popup search share sharing sidebar signup skip skyscraper social "
    "subscribe subscription toolbar topbar widget widgets".split()
)
#: Marks that an article element inside does not lift.
TEASERS = OTHERS | {"sidebar", "widget", "widgets"}
#: Words before a mark in one name, which then tells of a part and not of the element: has-header, post-with-comments.
PARTS = {"has", "with", "no", "without"}
#: An end tag that a new start tag implies, within the nearest enclosing list, table or section.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
IN_PARAGRAPH = BLOCK - {"option", "title", "head", "html", "body"}


class Node:
    """`furniture` by its element or an enclosing one; `marks` are the words that mark it, `size` the characters inside."""

    __slots__ = ("tag", "parent", "depth", "furniture", "marks", "raw", "credit", "size", "link")

    def __init__(self, tag: str, parent: Node | None, furniture: bool, marks: set[str] = frozenset()) -> None:
        self.tag, self.parent, self.marks, self.credit, self.size = tag, parent, marks, 0, 0
        self.raw = tag not in BLOCK and (furniture or bool(marks) or bool(parent and (parent.raw or parent.furniture)))
        self.link = tag == "a" or tag not in BLOCK and bool(parent and parent.link)
        self.depth = parent.depth + 1 if parent else 0
        self.furniture = furniture or bool(parent and parent.furniture)


def _marks(attributes: list[tuple[str, str | None]]) -> set[str]:
    found: set[str] = set()
    for name, value in attributes:
        if value and name in ("class", "id", "role"):
            for one in value.split():
                words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower())
                if not MARKS.isdisjoint(words) and PARTS.isdisjoint(words):
                    found |= MARKS.intersection(words)
    return found


def _hidden(attributes: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attributes)


def _left(lines: list[tuple[str, int, Node, int]]) -> list[tuple[str, int, Node, int]]:
    """The lines outside furniture.

    A mark holds for all inside it but for a main element and, unless it tells of others' text or teasers, an article
    element without a mark of its own. It does not hold at all on an element with most of the page's text that others
    did not write.
    """
    lines = [line for line in lines if not line[2].furniture]
    total = 0
    for text, _, node, _ in lines:
        if not _others(node):
            total += len(text)
            while node:
                node.size += len(text)
                node = node.parent
    return [line for line in lines if not _furnished(line[2], MOST * total)]


def _others(node: Node | None) -> bool:
    while node and node.tag != "main":
        if node.tag not in ("article", "html", "body") and not OTHERS.isdisjoint(node.marks):
            return True
        node = node.parent
    return False


def _furnished(node: Node | None, most: float) -> bool:
    article = False
    while node and node.tag != "main":
        if node.tag == "article":
            article = article or not node.marks
        elif node.tag not in ("html", "body") and node.marks and not (node.size >= most > 0):
            if not article or not TEASERS.isdisjoint(node.marks):
                return True
        node = node.parent
    return False


class Lines(HTMLParser):
    """Collects (text, tags, node, characters in links) of every block of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.node = Node("", None, False)
        self.lines: list[tuple[str, int, Node, int]] = []
        self.held: list[str] = []
        self.tags = self.linked = 0

    def cut(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.lines.append((text, self.tags, self.node, self.linked))
            self.tags = 0
        self.held, self.linked = [], 0

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.cut()
        elif tag == "br":
            self.held.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag in IN_PARAGRAPH:
            self._close({"p"}, BLOCK - {"p"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        hidden = tag not in ("html", "body", "main", "article") and _hidden(attributes)
        self.node = Node(tag, self.node, tag in FURNITURE or hidden, _marks(attributes))

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)

    def _close(self, tags: set[str], within: set[str]) -> None:
        node = self.node
        while node.parent and node.tag not in within:
            if node.tag in tags:
                self.node = node.parent
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        node = self.node
        while node.parent and node.tag != tag:
            if tag not in BLOCK and node.tag in BLOCK:
                return
            node = node.parent
        if node.parent:
            self.node = node.parent

    def handle_data(self, data: str) -> None:
        # Text right inside a raw element is dropped with it, a block of its own or not.
        if not self.node.raw:
            self.held.append(data)
            if self.node.link:
                self.linked += len(" ".join(data.split()))

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment that never ends takes the rest of the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end


def smoothed(values: list[float]) -> list[float]:
    weights = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for at in range(len(values)):
        near = [(w, values[k]) for w, k in zip(weights, range(at - RADIUS, at + RADIUS + 1)) if 0 <= k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def main_text(html: str) -> str:
    """The text of the content region, a line per block; empty if there is none."""
    last = html.find("<", html.rfind(">") + 1)
    if last >= 0 and html[last + 1 : last + 2].isalpha() or html[last + 1 : last + 2] in ("/", "!", "?") and last >= 0:
        html = html[:last]  # a tag cut off by the end of the page
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    lines = _left(parser.lines)
    if not lines:
        return ""
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _, _ in lines])
    mean = sum(ratios) / len(ratios)
    threshold = min(math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), max(ratios))
    total = 0
    for (text, _, node, _), ratio in zip(lines, ratios):
        if ratio >= threshold:
            total += len(text)
            while node:
                node.credit += len(text)
                node = node.parent
    best = None
    for _, _, node, _ in lines:
        while node:
            if node.credit >= MOST * total and (best is None or node.depth > best.depth) and node.tag not in LEAVES:
                best = node
            node = node.parent
    node = region = best
    while node:
        if node.tag in ("article", "main"):
            region = node
        node = node.parent
    around = set()
    node = region
    while node:
        around.add(node)
        node = node.parent
    # Of the elements beside the region, and of the blocks right inside an element around it: characters, those
    # in links, and whether there is content or a heading.
    beside: dict[Node, list[int]] = {}
    owners: list[Node | None] = []
    for (text, _, node, linked), ratio in zip(lines, ratios):
        owner = _beside(node, region, around)
        owners.append(owner)
        if owner and owner not in around:
            sums = beside.setdefault(owner, [0, 0, 0])
            for k, more in enumerate((len(text), linked, ratio >= threshold or _heading(node))):
                sums[k] += more
    out = []
    for (text, _, _, linked), ratio, owner in zip(lines, ratios, owners):
        if owner is None:
            out.append(text)
        else:
            size, links, content = beside.get(owner, (len(text), linked, ratio >= threshold))
            if content and 2 * links <= size:
                out.append(text)
    return "\n".join(out)


def _heading(node: Node | None) -> bool:
    while node and node.tag not in BLOCK:
        node = node.parent
    return bool(node) and node.tag in HEADINGS


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Not a region of their own: what holds them is.
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre caption figcaption legend summary td th tr tbody thead tfoot table ul ol dl a b i em strong span".split())


def _beside(node: Node, region: Node, around: set[Node]) -> Node | None:
    """None for what is inside the region; else the outermost element with `node` that does not enclose the region, or
    `node` itself where it does."""
    below = node
    while node not in around:
        below, node = node, node.parent
    return None if node is region else below


def extract_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Every row of `pages` with its main text in the column `into`, which replaces one of that name.

    NULL and empty html, and pages of furniture alone, have an empty text. Character references are
    decoded, white space within a block becomes one space, blocks are joined by newlines. Rows are
    independent, so repeated rows get equal texts and nothing is shuffled.
    """
    keep = [f for f in pages.schema.fields if f.name != into]
    schema = StructType([*keep, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(html).to_pylist()]
            columns = [batch.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*(f.name for f in keep), into])

    return pages.mapInArrow(run, schema)
