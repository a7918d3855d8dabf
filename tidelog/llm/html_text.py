"""Main text of HTML pages by text-to-tag ratios over streaming parser events.

The standard library's parser streams a page's events once.  Block elements
end a line; each line has its text, the tags met since the line before, and
the container it stands in; containers know their parents.  The text-to-tag
ratios of the lines are smoothed with a Gaussian, and lines over a threshold
(a part of their standard deviation) are the cluster of content lines.

Containers that by tag, class, id or role are menus, headers, footers,
sidebars, notices, adverts, forms or comments are suspects.  The ratio and the
structure decide: a suspect that holds the article (an article or main
element, a first heading, a name for content) and half of the cluster's text
is none, so neither a form around the whole page nor a class such as
``comments-open`` loses the article.  A suspect without an end tag of its own
ends where the next container begins.

The ratio alone would drop short paragraphs and headings of an article, so
the cluster only selects the region: the page's article elements among the
containers of its lines are taken whole, with the cluster's lines beside them
in a container that is named for content; without any, the lowest container
of all its lines, and of others as long as those, is, without lists of links.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What they hold is no text of the page.
HARD = frozenset("script style noscript template head title button select textarea iframe object svg math canvas datalist audio video map".split())
#: Suspects by their tag.
SUSPECT = frozenset("nav footer aside form menu dialog header".split())
#: Elements that other elements stand in; all others are inline or empty.
BOXES = frozenset("html body div section article main figure table tbody thead tfoot tr ul ol dl details fieldset center".split()) | SUSPECT
#: Begin and end a line.
BLOCKS = BOXES | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre hr address figcaption caption summary hgroup legend option script style noscript template head title iframe datalist".split())
#: Elements of these kinds that are open end where the next one begins.
_REPEATED = frozenset("p li dt dd td th tr option".split())
_IN_HEAD = frozenset("title style script noscript template head".split())
WHOLE = frozenset(("article", "main"))
#: Words of a class, id or role that make a container a suspect ...
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist reply replies respond disqus discussion share sharing social breadcrumb breadcrumbs pagination pager hidden contentinfo complementary alertdialog dialog search".split()
)
#: ... those that do so unless a word for content stands beside them ...
LAYOUT = frozenset("nav navbar navigation menu menus sidebar side aside footer foot header masthead topbar toolbar widget widgets related recommended recommendations toc tags".split())
#: ... words for content, and words that end the name of a state, not of a thing.
CONTENT = frozenset("article content main post entry story".split())
STATE = frozenset("open opened closed enabled disabled on off active inactive allowed print page yes no true false visible loaded ready default none".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
TAG, NAMED, UNSEEN = 1, 2, 3


class Page(HTMLParser):
    """The lines of a page and the tree of its containers, as parallel lists; container 0 is the page itself."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tags: list[int] = []  # met since the line before
        self.linked: list[int] = []  # characters in links
        self.box: list[int] = []
        self.kind, self.parent, self.mark, self.good, self.closed, self.titles = [""], [0], [0], [False], [True], [0]
        self.stack = [0]
        self.open: Counter[str] = Counter()
        self.hard = 0  # the stack's length below the outermost element that holds no text; 0: none is open
        self.parts: list[str] = []
        self.seen = self.links = self.in_link = 0
        self.feed(page)
        self.close()
        self._end()

    def _end(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.text.append(text)
                self.tags.append(self.seen)
                self.linked.append(self.links)
                self.box.append(self.stack[-1])
                self.seen = 0
        self.links = 0

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def _names(self, tag: str, attrs) -> tuple[int, bool]:
        """Whether an element is a suspect by its names, and whether it is named for content."""
        if tag in ("html", "body") or not attrs:
            return 0, False
        layout = noise = good = False
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
                return UNSEEN, False
            for name in v.split() if v and k in ("class", "id", "role") else ():
                words = [w.lower() for w in _WORD.findall(name)]
                if not words or len(words) > 1 and words[-1] in STATE:
                    continue
                noise |= not NOISE.isdisjoint(words)
                layout |= not LAYOUT.isdisjoint(words)
                good |= not CONTENT.isdisjoint(words)
        if tag in WHOLE:
            layout = False
        return (NAMED if noise or layout and not good else 0), good

    def _push(self, tag: str, mark: int, good: bool) -> None:
        self.kind.append(tag)
        self.parent.append(self.stack[-1])
        self.mark.append(mark)
        self.good.append(good)
        self.closed.append(False)
        self.titles.append(0)
        self.stack.append(len(self.kind) - 1)
        self.open[tag] += 1

    def _cut(self, depth: int) -> None:
        for b in self.stack[depth:]:
            self.open[self.kind[b]] -= 1
        del self.stack[depth:]
        if self.hard and self.hard >= len(self.stack):
            self.hard = 0

    def _pop(self, tag: str, explicit: bool = True) -> None:
        if self.open[tag]:
            k = len(self.stack) - 1
            while self.kind[self.stack[k]] != tag:
                k -= 1
            self.closed[self.stack[k]] = explicit
            self._cut(k)

    def handle_starttag(self, tag, attrs):
        self.seen += 1
        if self.hard:
            outer = self.kind[self.stack[self.hard]]
            if tag in WHOLE or tag in ("h1", "body") or outer == "head" and tag in BLOCKS and tag not in _IN_HEAD:
                self._cut(self.hard)  # an end tag is missing
            else:
                if tag in HARD:
                    self._push(tag, 0, False)
                return
        if tag in BLOCKS:
            self._end()
            top = self.kind[self.stack[-1]]
            if top == "p" or top == tag and tag in _REPEATED:
                self._pop(top)
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.in_link = 1
        elif tag in HARD:
            self.hard = len(self.stack)
            self._push(tag, 0, False)
        elif tag in BLOCKS:
            if tag == "h1":
                self.titles[self.stack[-1]] += 1
            mark, good = self._names(tag, attrs)
            if tag in SUSPECT and not (tag == "header" and any(self.open[t] for t in WHOLE)):
                mark = max(mark, TAG)
            if tag in BOXES or mark:
                self._push(tag, mark, good)
        elif attrs and self._names(tag, attrs)[0] and tag in ("span", "ins", "label", "b", "i", "em", "strong", "small", "font"):
            self.hard = len(self.stack)
            self._push(tag, 0, False)

    def handle_startendtag(self, tag, attrs):
        self.seen += 1
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS and not self.hard:
            self._end()

    def handle_endtag(self, tag):
        self.seen += 1
        if tag in BLOCKS and not (self.hard and tag in self.kind[self.stack[self.hard]]):
            if not self.hard or self.open[tag]:
                self._end()
        if tag == "a":
            self.in_link = 0
        self._pop(tag)

    def handle_data(self, data):
        if self.hard:
            self.parts.append(" ")
            return
        self.parts.append(data)
        if self.in_link:
            self.links += len(data.strip())

    def up(self, own: np.ndarray) -> np.ndarray:
        """Sums over each container and all in it."""
        total = own.copy()
        for b in range(len(self.parent) - 1, 0, -1):
            total[self.parent[b]] += total[b]
        return total

    def noise(self, chosen: np.ndarray, trust: int = 0) -> np.ndarray:
        """Which containers hold no main text; ``chosen`` are the cluster's lines. ``trust`` 1 forgives names, 2 forms and asides too."""
        n = len(self.kind)
        size = np.array([len(t) for t in self.text])
        mass = self.up(np.bincount(np.array(self.box)[chosen], size[chosen], n))
        whole = self.up(np.array([float(k in WHOLE and not m) for k, m in zip(self.kind, self.mark, strict=True)]))
        titles = self.up(np.array(self.titles, float))
        out, ended = [False] * n, [False] * n
        for b in range(1, n):
            mark, kind = self.mark[b], self.kind[b]
            holds = whole[b] or titles[b] or self.good[b] or kind in WHOLE
            half = mass[b] * 2 >= mass[0] > 0
            own = mark > 0
            if mark == TAG and kind == "form" and (holds or half) or mark in (NAMED, UNSEEN) and holds and half:
                own = False
            if trust and mark in (NAMED, UNSEEN) or trust > 1 and mark == TAG and kind in ("form", "aside"):
                own = False
            over = self.parent[b]
            out[b] = own or out[over] and not (ended[over] and kind in BOXES)
            ended[b] = own and not self.closed[b] and kind not in _REPEATED
        return np.array(out)


def smoothed(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    radius = max(1, round(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, radius), kernel / kernel.sum(), "valid")


def content_lines(x: np.ndarray, sigma: float = 1.0, part: float = 1.0) -> np.ndarray:
    """The cluster of content lines: smoothed ratio ``x`` above ``part`` of the ratios' standard deviation."""
    if not x.any():
        return np.zeros(len(x), bool)
    s = smoothed(x, sigma)
    found = (s >= part * x.std()) & (x > 0)
    return found if found.any() else x == x.max()


def main_text(page: str, sigma: float = 1.0, part: float = 1.0) -> str:
    """Blocks of the main text, each with single spaces, joined by line breaks."""
    tree = Page(page)
    if not tree.text:
        return ""
    box = np.array(tree.box)
    ratio = np.array([len(t) for t in tree.text]) / np.maximum(1, tree.tags)  # characters for each tag
    first = content_lines(ratio, sigma, part)
    for trust in range(3):
        noise = tree.noise(first, trust)[box]
        chosen = content_lines(np.where(noise, 0.0, ratio), sigma, part)
        if chosen.any() and (not trust or chosen.sum() > 1):  # what only trust brings back must be more than a notice
            break
    else:
        return ""
    n = len(tree.kind)
    inside = tree.up(np.bincount(box[chosen], minlength=n).astype(float))
    for tag in ("article", "main"):
        region = np.array([k == tag for k in tree.kind]) & (inside > 0)
        if region.any():
            within = _below(tree, region)
            named = _below(tree, np.array([k == "main" or g for k, g in zip(tree.kind, tree.good, strict=True)]) & (tree.up(region.astype(float)) > 0))
            keep = within[box] | chosen & named[box]
            break
    else:
        size, linked = np.array([len(t) for t in tree.text]), np.array(tree.linked)
        like = chosen | ~noise & (size * 2 >= np.median(size[chosen])) & (linked * 2 < size)  # also lines as long as those, after many tags
        inside, top = tree.up(np.bincount(box[like], minlength=n).astype(float)), 0
        for b in range(1, n):  # the lowest container of all these lines
            if inside[b] == inside[0]:
                top = b
        region = np.zeros(n, bool)
        region[top] = True
        lines, links, chars = (tree.up(np.bincount(box, w, n)) for w in (None, linked, size))
        menu = (inside == 0) & (lines > 2) & (links > 0.8 * chars)
        keep = (_below(tree, region) & ~_below(tree, menu))[box]
    return "\n".join(tree.text[k] for k in np.flatnonzero(keep & ~noise).tolist())


def _below(tree: Page, marked: np.ndarray) -> np.ndarray:
    """The marked containers and all that stand in them."""
    out = marked.copy()
    for b in range(1, len(out)):
        out[b] |= out[tree.parent[b]]
    return out


def extract(pages: DataFrame, sigma: float = 1.0, part: float = 1.0) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages``.

    Null or empty html, and pages without main text, have an empty text.
    Broken markup is read as far as it goes.  Repeated rows repeat.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batch: pa.RecordBatch):
        html = batch.column(2)
        for a in range(0, batch.num_rows, 500):
            out = [main_text(h, sigma, part) for h in html[a : a + 500].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 500], batch.column(1)[a : a + 500], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return common.map_batches(source, run, "page_id long, url string, text string, n_chars long")
