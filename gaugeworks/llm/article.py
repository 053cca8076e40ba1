"""Main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one per block element. The text of menus, headers, footers, side bars, notices, adverts, forms,
scripts and reader comments, told by element, role and class names, leaves empty lines. The lengths of the text outside links
are summed over windows of successive lines. Text begins at a surge, where a window's sum passes the threshold, and ends at
the last dive, where it falls to it again; what stands between is kept. Where a page marks its article (`article`, `main`
or role=main), the text outside weighs nothing and the threshold is zero, so that short articles and paragraphs stay whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeworks.llm.arrays import release
from gaugeworks.llm.packing import slices

#: Lines of a window, and the characters of a window's text that make a surge on pages that don't mark their article.
WINDOW = 3
SURGE = 80

# Element names of HTML, and names that pages give to what isn't their article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
DROPPED = RAW | set("head nav footer aside form button select option datalist input object applet audio video canvas svg math map dialog menu".split())
BLOCKS = set("address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre search section summary table tbody tfoot thead tr ul aside".split())
BOXES = set("article body div main section td th".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead "
    "footer sidebar aside widget widgets related recommended recommendations teaser teasers "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer "
    "newsletter subscribe subscription signup login search share sharing social "
    "comment comments reply replies respond disqus discussion".split()
)
HEADER_NAMES = {"header"}
CLOSES_P = BLOCKS - set("caption legend tbody tfoot thead tr body html".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-zA-Z][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PART = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Line:
    """boxes: the open container elements around it, the innermost last."""

    __slots__ = ("text", "size", "inside", "boxes", "heading")

    def __init__(self, text: str, size: int, inside: int, boxes: list[int], heading: bool):
        self.text, self.size, self.inside, self.boxes, self.heading = text, size, inside, boxes, heading


def boilerplate(name: str, attributes: str) -> bool:
    """Whether an element's role, class or id says that its text isn't the article's."""
    if not attributes.strip():
        return False
    if HIDDEN.search(attributes):
        return True
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "role" and value.strip().lower() in ROLES:
            return True
        if key in ("class", "id") and not NAMES.isdisjoint(words_of(value)):
            return True
    return False


def words_of(value: str) -> list[str]:
    return PART.findall(CAMEL.sub(" ", value).lower())


def header(name: str, attributes: str) -> bool:
    return name == "header" or any(k.lower() in ("class", "id") and not HEADER_NAMES.isdisjoint(words_of("".join(v))) for k, *v in ATTRIBUTE.findall(attributes))


class Page:
    """The lines of one page. `open` has the open elements: (name, drops its text, is a header, opens an article, its box)."""

    def __init__(self, source: str):
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, int, int]] = []
        self.parts: list[str] = []
        self.linked = self.dropped = self.headers = self.links = self.headings = 0
        self.marks = [0, 0]  # open elements that mark an article, and a main part
        self.boxes = 0
        at, low, end = 0, None, len(source)
        while at < end:
            tag = TAG.search(source, at)
            self.say(source[at : tag.start() if tag else end])
            if not tag:
                break
            at = tag.end()
            name = (tag[2] or "").lower()
            if not name:
                continue
            if tag[1]:
                self.close(name)
                continue
            self.begin(name, tag[3])
            if name in RAW:
                low = low if low is not None else source.lower()
                stop = low.find(f"</{name}", at)
                self.close(name)
                at = end if stop < 0 else stop
        self.line()

    def say(self, text: str) -> None:
        if text and not self.dropped and (not self.headers or (self.headings and any(self.marks))):
            text = entities.unescape(text)
            self.parts.append(text)
            if self.links:
                self.linked += len("".join(text.split()))

    def line(self) -> None:
        """End the line: its white space becomes single spaces."""
        text = " ".join("".join(self.parts).split())
        if text:
            inside = 2 if self.marks[0] else 1 if self.marks[1] else 0
            self.lines.append(Line(text, len(text.replace(" ", "")) - self.linked, inside, [e[4] for e in self.open if e[4]], bool(self.headings)))
        self.parts, self.linked = [], 0

    def gap(self) -> None:
        """Empty lines in the place of dropped text."""
        self.line()
        if self.lines and self.lines[-1].text:
            self.lines += [Line("", 0, 0, [], False)] * WINDOW

    def begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
        if name in ("td", "th"):
            self.parts.append(" ")
        if name in CLOSES_P and any(e[0] == "p" for e in self.open[-8:]):
            self.close("p")
        if name in ("li", "tr", "dt", "dd") and self.open and self.open[-1][0] == name:
            self.close(name)
        if name == "body":
            self.close("head")
        if name in BLOCKS:
            self.line()
        if name in VOID or (self.dropped and attributes.endswith("/")):
            return
        kept = name in ("html", "body")
        role_main = name == "main" or (not kept and re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I) is not None)
        marks = 1 if name == "article" else 2 if role_main else 0
        drop = not kept and (name in DROPPED or (boilerplate(name, attributes) and not self.content(name, attributes, marks)))
        top = not kept and not drop and not marks and header(name, attributes)
        box = 0
        if name in BOXES and name != "body":
            self.boxes += 1
            box = self.boxes
        if drop and not self.dropped:
            self.gap() if name in BLOCKS or name in RAW else None
        self.open.append((name, drop, top, marks, box))
        self.count(name, drop, top, marks, 1)

    def content(self, name: str, attributes: str, marks: int) -> bool:
        """An element that marks the article is dropped only where a whole class name says that it is a comment or teaser."""
        names = {w for k, *v in ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id") for w in "".join(v).lower().split()}
        return marks > 0 and not names & {"comment", "comments", "reply", "teaser", "related"}

    def count(self, name: str, drop: bool, top: bool, marks: int, by: int) -> None:
        self.dropped += by * drop
        self.headers += by * top
        self.links += by * (name == "a")
        self.headings += by * (name in HEADINGS)
        if marks:
            self.marks[marks - 1] += by

    def close(self, name: str) -> None:
        """Close the innermost open `name` and what is open in it; an end without a begin is nothing. A block element inside
        an inline one isn't closed by the inline one's end."""
        if name in BLOCKS:
            self.line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                for e in self.open[k:]:
                    self.count(*e[:4], -1)
                del self.open[k:]
                return
            if self.open[k][0] in BOXES and name not in BLOCKS:
                return


def main_text(source: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page: its blocks in page order, joined by line feeds; empty for an empty or null page."""
    page = Page(source or "")
    lines = page.lines
    level = max((x.inside for x in lines), default=0)
    if level:
        size, limit = np.array([len(x.text) if x.inside >= level else 0 for x in lines]), 0
        return "\n".join(x.text for x, y in zip(lines, between(size, window, limit)) if y and x.inside >= level and x.text)
    size = np.array([x.size for x in lines], np.int64)
    sums = windows(size, window)
    keep = between(size, window, min(surge, int(sums.max(initial=0)) // 2))
    beside = Counter(b for x in lines for b in x.boxes)
    own = [next((b for b in reversed(x.boxes) if beside[b] > 1), 0) for x in lines]  # the innermost element with further lines
    boxes = {b for x, y, b in zip(lines, keep, own) if y and x.size > surge} - {0}
    keep |= np.array([b in boxes for b in own], bool)  # short lines beside long ones in one element
    at = np.flatnonzero(keep)
    first, last = (at[0], at[-1]) if len(at) else (0, -1)
    while first > 0 and lines[first - 1].heading:
        first -= 1
    return "\n".join(x.text for x in lines[first : last + 1] if x.text)


def windows(size: np.ndarray, window: int) -> np.ndarray:
    """Text in the `window` lines from each line on."""
    total = np.concatenate([[0], np.cumsum(size), np.full(window, size.sum())])
    return total[window : window + len(size)] - total[: len(size)]


def between(size: np.ndarray, window: int, limit: int) -> np.ndarray:
    """Lines from the first surge to the last dive: a surge is a line with text whose window holds more than `limit`, a dive
    the last line with text before a window falls to it."""
    high = (windows(size, window) > limit) & (size > 0)
    back = (windows(size[::-1], window)[::-1] > limit) & (size > 0)
    at = np.flatnonzero(high | back)
    keep = np.zeros(len(size), bool)
    if len(at):
        keep[at[0] : at[-1] + 1] = True
    return keep


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All columns of `pages` and `out`, the main text of the whole `html`; a column of that name is replaced.

    Null, empty and text-free pages give an empty text. Pages are read one by one, so that a task holds a batch of pages
    and the lines of one; repeated rows are repeated. Character references are decoded once, by the rules of HTML. White
    space is what Python's str.split() takes for it. Lines of an article are never dropped for being short.
    """
    rows = pages.drop(out)
    schema = rows.select("*", F.lit("").cast("string").alias(out)).schema

    def read(batches):
        for batch in batches:
            k = batch.schema.get_field_index(html)
            keyed = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int32()), batch.column(k)], names=["row", "html"])
            for part in slices(keyed):
                texts = pa.array([main_text(x) for x in part.column(1).to_pylist()], pa.string())
                rest = batch.slice(part.column(0)[0].as_py(), part.num_rows)
                yield pa.RecordBatch.from_arrays([*rest.columns, texts], names=[*batch.schema.names, out])
        release()

    return rows.mapInArrow(read, schema)
