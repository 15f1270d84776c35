"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, thresholds.

The standard-library parser streams events; block elements cut the page into lines, each with its
text, its number of tags, the part inside links, and the containers it lies in. Elements that
never hold main text (scripts, menus, forms, adverts, comments, ...) are passed over. The
text-to-tag ratios of the lines are smoothed with a Gaussian, lines above the threshold form
content regions, and the innermost article or main that holds most of the regions' text is the
article: all its lines are returned, so a short paragraph between long ones is kept. Without one it
is the innermost container of all regions; there, lines that lie in links are left out, outside the
regions those that mostly do. Inside an article a class or an id counts only if it says nothing but what is
no main text, as "share-buttons" does and "share-price" does not; where the word may also name a
section, as "discussion" does, the element's text must say so too: most of it lies in links, or it
has few characters a tag.

Parsing takes time and memory in proportion to the page, however deeply it is nested.

Edge cases: null or empty html gives an empty text; a page without any text outside the passed
elements gives an empty text; of containers that tie the innermost is taken; unclosed and stray tags
are tolerated; very long pages are parsed whole; a repeated row is parsed again; an empty table gives
no rows; only page_id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm import common as C

SIGMA = 1.0
#: A line belongs to a region when its smoothed ratio reaches this share of the mean ratio.
THRESHOLD = 0.5
#: An article or main is taken when it has this share of the regions' text.
MOST = 0.6
#: A marked element of an article goes when this share of its text lies in links, or its characters
#: a tag are below this share of the article's.
LINKED, SPARSE = 0.5, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset(
    "script style noscript template svg math iframe object head title nav footer aside form button "
    "select textarea fieldset dialog menu audio video canvas".split()
)
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul aside dialog".split()
)
CONTAINER = frozenset("article body div main section td table figure details blockquote".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
#: Words of class, id and role values that mark what is no main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside "
    "rail widget widgets related recommended recommendations share sharing social comment comments "
    "commentlist reply replies respond disqus discussion footer foot header masthead topbar toolbar "
    "pagination pager skip search contentinfo complementary dialog".split()
)
#: Those of them that may name a section of an article as well.
AMBIGUOUS = frozenset(
    "notice notices alert banner search skip side rail aside head header footer dialog discussion promotion "
    "reply replies respond navigation complementary toolbar masthead recommended recommendations".split()
)
#: Words that go with a mark and say nothing themselves.
LAYOUT = frozenset(
    "area bar block body box btn button buttons card col column container content count group holder icon icons "
    "inner item items label left link links list main module outer panel post row right section slot text "
    "thread title top unit wrap wrapper".split()
)
#: First words of class names that tell a state, as in "has-sidebar", not what an element is.
STATES = frozenset("has no with without".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _names(attrs: list[tuple[str, str | None]]) -> Iterator[list[str]]:
    """The words of every class, id and role, less those that tell a state."""
    for name, value in attrs:
        if value and name in ("class", "id", "role", "aria-label", "itemprop"):
            for one in value.split():
                parts = [x for x in _SPLIT.split(_CAMEL.sub("-", one).lower()) if x]
                if parts and parts[0] not in STATES:
                    yield parts


def _marked(attrs: list[tuple[str, str | None]]) -> bool:
    return _hidden(attrs) or any(not MARKS.isdisjoint(parts) for parts in _names(attrs))


def _mark_in_article(attrs: list[tuple[str, str | None]]) -> str | None:
    """"sure" if a name of the element says only what is no main text, "maybe" if its words may
    name a section too, else None."""
    found = None
    for parts in _names(attrs):
        words = [x for x in parts if not x.isdigit() and x not in LAYOUT]
        if words and MARKS.issuperset(words):
            if not AMBIGUOUS.issuperset(words):
                return "sure"
            found = "maybe"
    return found


class _Lines(HTMLParser):
    """Lines of a page: [text parts, tags, characters in links, container, mark].

    Containers and marks are numbers that know their parents; positions of open elements are kept
    by tag, so no step looks through the stack.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # (tag, passed over, container, mark)
        self.open: dict[str, list[int]] = {}
        self.skips: list[int] = []
        self.fences: list[int] = []  # article, main, body
        self.holders: list[int] = []  # containers and list items
        self.seen_article = False
        self.container, self.mark = 0, 0
        self.kinds, self.parents, self.depths = ["page"], [0], [0]
        self.mark_parents = [0]
        self.lines: list[list] = []
        self._new_line()

    def _last(self, *tags: str) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _new_line(self) -> None:
        place = [self.container, self.mark]
        if self.lines and not self.lines[-1][0]:
            self.lines[-1][3:] = place
        else:
            self.lines.append([[], 0, 0, *place])

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, skip, container, mark = self.stack.pop()
            at = len(self.stack)
            self.open[tag].pop()
            for places in (self.skips, self.fences, self.holders):
                if places and places[-1] == at:
                    places.pop()
            if container:
                self.container = self.parents[self.container]
            if mark:
                self.mark = self.mark_parents[self.mark]
                if not self.skips:
                    self._new_line()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if not self.skips:
                self.lines[-1][1] += 1
                if tag == "br":
                    self.lines[-1][0].append(" ")
                elif tag == "hr":
                    self._new_line()
            return
        if tag in ARTICLE and self.skips and not self.seen_article and self._last("template", "noscript") < 0:
            # the page's article never lies in a menu or an advert: what was left open ends here
            if not _marked(attrs):
                self._pop_to(self.skips[0])
        elif tag in BLOCK and self.open.get("p"):
            # a block ends an open paragraph, unless a container was opened inside it
            at = self.open["p"][-1]
            if not self.holders or self.holders[-1] < at:
                self._pop_to(at)
        elif tag == "a" and self.open.get("a"):
            self._pop_to(self.open["a"][-1])
        if tag == "li" and self.open.get("li") and self._last("ul", "ol") < self.open["li"][-1]:
            self._pop_to(self.open["li"][-1])
        in_article = self._last("article", "main") >= 0
        plain = tag not in ("html", "body", "article", "main")
        skip = tag in SKIP or tag == "header" and not in_article or plain and _hidden(attrs)
        mark = False
        # the id of a heading is mostly an anchor made of its words
        if not skip and not self.skips and tag not in HEADING and (plain or tag == "article" and in_article):
            if in_article:
                kind = _mark_in_article(attrs)
                skip, mark = kind == "sure", kind == "maybe"
            else:
                skip = _marked(attrs)
        at = len(self.stack)
        if tag in CONTAINER:
            self.kinds.append(tag)
            self.parents.append(self.container)
            self.depths.append(self.depths[self.container] + 1)
            self.container = len(self.kinds) - 1
        if mark:
            self.mark_parents.append(self.mark)
            self.mark = len(self.mark_parents) - 1
        self.stack.append((tag, skip, tag in CONTAINER, mark))
        self.open.setdefault(tag, []).append(at)
        if skip:
            self.skips.append(at)
        if tag in ARTICLE or tag == "body":
            self.fences.append(at)
        if tag in CONTAINER or tag == "li":
            self.holders.append(at)
        if not self.skips:
            self.seen_article |= tag in ARTICLE
            if tag in BLOCK or mark:
                self._new_line()
            self.lines[-1][1] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    def handle_endtag(self, tag: str) -> None:
        at = self._last(tag)
        if at < 0 or self.fences and self.fences[-1] > at and tag not in ("article", "main", "body", "html"):
            return
        was = bool(self.skips)
        self._pop_to(at)
        if not self.skips:
            if not was:
                self.lines[-1][1] += 1
            if tag in BLOCK:
                self._new_line()

    def handle_data(self, data: str) -> None:
        if not self.skips:
            line = self.lines[-1]
            line[0].append(data)
            if self.open.get("a"):
                line[2] += len(data.strip())


def content_regions(ratios: np.ndarray, sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Lines whose smoothed ratio reaches the threshold."""
    if not len(ratios):
        return np.zeros(0, dtype=bool)
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    padded = np.pad(ratios, 3, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), mode="valid")
    return smooth >= threshold * smooth.mean()


def _up(values: np.ndarray, parents: list[int]) -> np.ndarray:
    """Sums over each number and all below it; parents come before their children."""
    for k in range(len(values) - 1, 0, -1):
        values[parents[k]] += values[k]
    return values


def without_boilerplate(lines: list[tuple], parents: list[int]) -> list[tuple]:
    """Lines less those of marked elements whose text, too, says that they are no main text."""
    sums = np.zeros((len(parents), 3))
    for text, tags, linked, _, mark in lines:
        sums[mark] += (len(text), tags, min(linked, len(text)))
    usual = sums[0][0] / sums[0][1] if sums[0][1] else 0.0
    gone = [False]
    for (n, tags, linked), parent in zip(_up(sums, parents)[1:], parents[1:]):
        gone.append(gone[parent] or bool(n) and bool(linked > LINKED * n or n / tags < SPARSE * usual))
    return [x for x in lines if not gone[x[4]]]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = []
    for parts, tags, linked, container, mark in parser.lines:
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, max(1, tags), linked, container, mark))
    lines = without_boilerplate(lines, parser.mark_parents)
    if not lines:
        return ""
    chars = np.array([len(x[0]) for x in lines], dtype=float)
    unlinked = np.array([max(0, len(x[0]) - x[2]) for x in lines], dtype=float)
    chosen = content_regions(unlinked / np.array([x[1] for x in lines]))
    counted = chosen & (unlinked > 0)
    # (text, lines) of the regions in every container
    mass = np.zeros((len(parser.kinds), 2))
    np.add.at(mass, [x[3] for x in lines], np.stack([unlinked * counted, counted], axis=1))
    mass = _up(mass, parser.parents)
    depth, kinds = parser.depths, parser.kinds
    named = [c for c in range(len(kinds)) if kinds[c] in ARTICLE and mass[c][1] and mass[c][0] >= MOST * mass[0][0]]
    whole = [c for c in range(len(kinds)) if mass[c][1] and mass[c][1] == mass[0][1]]
    best = max(named, key=lambda c: (depth[c], mass[c][0])) if named else max(whole, key=lambda c: depth[c], default=0)
    inside = [best == 0]
    for c in range(1, len(kinds)):
        inside.append(c == best or inside[parser.parents[c]])
    out = []
    for (text, _, linked, container, _), n, ok in zip(lines, chars, chosen):
        # a block of links is a menu, except inside an element that says it is the article
        menu = kinds[best] not in ARTICLE and linked > (0.8 if ok else LINKED) * n
        if inside[container] and not menu:
            out.append(text)
    return " ".join(out)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_SCHEMA)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    C.prepare(pages.sparkSession)
    rows = pages.selectExpr("cast(page_id AS bigint) AS page_id", "cast(url AS string) AS url", "html")
    return rows.mapInArrow(_batches, "page_id long, url string, text string, n_chars long")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
