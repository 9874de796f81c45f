"""Main text of web pages.

Events of the standard library's parser are turned into lines (a line for each
block of text) as they arrive. Each line has a text-to-tag ratio; the ratios are
smoothed with a Gaussian, and lines above their standard deviation form the
content cluster. The region is the innermost element that holds most of the
cluster's text (of those that do, an article or main element before others), so
that several articles side by side are one region. All of its lines are kept,
short ones too, except those in elements that are menus, adverts, forms and the
like by their tag, role or class; where a class may also name a part of an article,
the cluster decides.

Defined results: a null or empty page, or one without text, gives an empty
string; null ids and urls are kept; repeated rows are extracted each by itself;
unclosed and stray tags are tolerated; pages are read whole, whatever their
length or depth; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never part of the article.
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea label iframe object embed svg math canvas audio video menu dialog".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promoted adsense banner banners "
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager toc "
    "sidebar sidebars aside rail widget widgets masthead footer colophon copyright "
    "comment comments commentlist disqus replies reply respond "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login paywall disclaimer "
    "share sharing social related recommended recommendations trending popular tags taglist byline skip hidden".split()
)
#: Words that may stand beside a mark in one class or id, as in ``nav-bar``; beside any other word (``related-work``) a mark means nothing.
BESIDE = frozenset(
    "area bar block body bottom box btn button buttons col column container content desktop float global group icon icons inner item items js left link links list local main message mobile "
    "module outer page panel post posts primary right row secondary section site slot space story stories text to toggle top unit view wrap wrapper".split()
)
#: Words that may mark a part of the article as well: its lines stay if they are in the cluster.
DOUBTFUL = frozenset("header discussion reactions".split())
#: What a start tag closes, if one is open nearer than the given scope.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements that a region may be, besides the whole page.
REGIONS = BLOCK - frozenset("p li td th tr h1 h2 h3 h4 h5 h6 pre blockquote".split())
P_SCOPE = BLOCK - {"p"}
WORDS = re.compile(r"[a-z]+")


def marks(value: str) -> set[str]:
    """The marks of a class or id attribute: of each name whose words are all marks or may stand beside one."""
    found: set[str] = set()
    for name in value.lower().split():
        parts = WORDS.findall(name)
        own = MARKS.intersection(parts)
        if own and BESIDE.issuperset(p for p in parts if p not in own):
            found |= own
    return found


class Lines(HTMLParser):
    """Collects lines: their text, tags, characters in links and the path of their elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, element number, dropped
        self.parents: list[int] = [-1]  # by element number; 0 is the page
        self.names: list[str] = [""]
        self.doubtful: list[bool] = [False]
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        self.blocks: list[int] = []  # of block elements
        self.walls: list[int] = []  # of those that an inline end tag doesn't reach beyond
        self.lines: list[tuple[str, int, int, int, bool]] = []  # text, tags, link characters, element, dropped
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def _where(self) -> tuple[int, bool]:
        return self.stack[self.blocks[-1]][1] if self.blocks else 0, bool(self.stack) and self.stack[-1][2]

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, *self._where()))
            self.tags = 0
        self.text, self.linked = [], 0

    def _pop_to(self, k: int) -> None:
        for tag, _, _ in self.stack[k:]:
            self.links -= tag == "a"
            self.open[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
                if tag != "p":
                    self.walls.pop()
        del self.stack[k:]

    def _close(self, tags: set[str], scope: frozenset | set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in reversed(self.blocks):
            if self.stack[k][0] in tags:
                self.flush()
                self._pop_to(k)
                return
            if self.stack[k][0] in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in ("br", "hr", "img", "wbr"):
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in VOID:
            return
        if tag in BLOCK:
            self.flush()
            self._close({"p"}, P_SCOPE)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        above = bool(self.stack) and self.stack[-1][2]
        known = dict(attrs)
        named = " ".join(known.get(key) or "" for key in ("class", "id")) if "class" in known or "id" in known else ""
        marked = marks(named) if named else ()
        dropped = (
            above
            or tag in DROPPED
            or (tag == "header" and not self.open["article"])
            or (known.get("role") or "").lower() in ROLES
            or "hidden" in known
            or known.get("aria-hidden") == "true"
            or (tag not in ("html", "body", "main", "article") and bool(marked))
            or (tag == "article" and not {"comment", "comments", "reply", "ad", "advert", "promo", "related"}.isdisjoint(marked))
        )
        if dropped != above:
            self.flush()
        self.links += tag == "a"
        parent = self.stack[-1][1] if self.stack else 0
        self.parents.append(parent)
        self.names.append(tag)
        self.doubtful.append(self.doubtful[parent] or bool(named) and not DOUBTFUL.isdisjoint(WORDS.findall(named.lower())))
        self.open[tag].append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
            if tag != "p":
                self.walls.append(len(self.stack))
        self.stack.append((tag, len(self.parents) - 1, dropped))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # browsers ignore the slash

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        k = self.open[tag][-1] if self.open[tag] else -1
        if tag not in BLOCK and self.walls and k < self.walls[-1]:
            return  # a stray inline end tag doesn't close blocks
        if k >= 0:
            if tag in BLOCK or self.stack[k][2] != (self.stack[k - 1][2] if k else False):
                self.flush()
            self._pop_to(k)
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float = 1.0, radius: int = 2) -> np.ndarray:
    kernel = np.exp(-np.square(np.arange(-radius, radius + 1)) / (2 * sigma * sigma))
    if len(ratios) == 0:
        return ratios
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def extract(html: str | None, share: float = 0.7) -> str:
    """The article's blocks, one a line; ``share`` is the part of the cluster's text that the region holds at least."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    smooth = smoothed(np.array([len(x[0]) / max(1, x[1]) for x in lines]))
    cluster = smooth >= min(smooth.std(), smooth.max())
    kept = [not x[4] and (bool(c) or not parser.doubtful[x[3]]) for x, c in zip(lines, cluster, strict=True)]
    if not any(c and k for c, k in zip(cluster, kept, strict=True)):
        cluster = np.ones(len(lines), dtype=bool)  # the cluster is all boilerplate, so what else there is counts

    # elements are numbered before what they hold, so masses add up backwards
    mass = [0] * len(parser.parents)
    for (text, _, linked, at, _), c, k in zip(lines, cluster, kept, strict=True):
        if c and k:
            mass[at] += max(0, len(text) - linked)
    for k in range(len(mass) - 1, 0, -1):
        mass[parser.parents[k]] += mass[k]
    # of elements that hold most of the cluster each lies in the one before
    most = [k for k in range(len(mass)) if mass[k] >= share * mass[0] > 0]
    named = [k for k in most if parser.names[k] in ("article", "main")]
    region = named[-1] if named else max((k for k in most if parser.names[k] in REGIONS), default=0)
    inside = [False] * len(mass)
    inside[region] = True
    for k in range(1, len(mass)):
        inside[k] = inside[k] or inside[parser.parents[k]]

    menus = Counter()
    for text, _, linked, at, _ in lines:
        if parser.names[at] == "li":
            menus[parser.parents[at], linked >= 0.9 * len(text.replace(" ", ""))] += 1
    out = []
    for (text, _, _, at, _), k in zip(lines, kept, strict=True):
        whole = parser.parents[at]
        menu = parser.names[at] == "li" and menus[whole, True] >= 3 and not menus[whole, False]
        if k and inside[at] and not menu:
            out.append(text)
    return "\n".join(out)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id``, ``url`` and ``text`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([extract(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), got], ["id", "url", "text"])

    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return source.mapInArrow(run, "id long, url string, text string")
