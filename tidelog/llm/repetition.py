"""Quality rules on repetition inside a text, by suffix arrays over words.

The words of a batch of documents, made distinct between documents, are
sorted as suffixes by prefix doubling; only suffixes that are still tied with
a neighbour are sorted on, so plain prose costs two or three passes.  The
ranks of the first passes give the common prefixes of neighbours up to
``2 ** KEPT`` words; longer ones are measured on the text itself, going from
a start to the next, whose common prefix is shorter by one word at most.  So
memory is linear in the words, however long a repeat is.

A walk over the longest-common-prefix intervals lists the maximal repeats.  A
suffix belongs to the highest interval it lies in; the union of the spans of
all suffixes, each as long as its interval is high, is that of all maximal
repeats.  Its part of the text and the highest interval make the verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SYMBOLS = "#*$%&|<>"
#: Repeats of fewer words don't count as covered.
MIN_REPEAT = 8
#: A document is rejected if more than this part of its words is covered ...
MAX_COVERED = 0.3
#: ... or if one repeat is longer than this many words.
MAX_REPEAT = 200
#: Words sorted together.
CHUNK_WORDS = 250_000


#: Ranks of so many passes of the doubling are kept for common prefixes.
KEPT = 6
#: Words of a long text that are read at a time.
READ = 1 << 20


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, lcp)`` of the suffixes of several sequences laid end to end.

    ``ends[i]`` is where the sequence of position i ends; sequences have no
    symbols in common.  ``lcp[k]`` is the common prefix of suffixes
    ``order[k - 1]`` and ``order[k]`` (0 for the first).
    """
    n = len(symbols)
    kind = np.int32 if n < 2**30 else np.int64
    if not n:
        return np.zeros(0, kind), np.zeros(0, kind)
    ends = ends.astype(kind)
    order = np.argsort(symbols, kind="stable").astype(kind)
    s = symbols[order]
    head = np.r_[True, s[1:] != s[:-1]]
    del s
    rank = np.empty(n, kind)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=kind), 0))  # the place of the first of the ties
    levels, width = [rank.copy()], 1
    while True:
        at = np.flatnonzero(~(head & np.r_[head[1:], True])).astype(kind)
        if not len(at):
            break
        who = order[at]
        nxt = who + kind(width)
        key = np.where(nxt < ends[who], rank[np.minimum(nxt, n - 1)] + 1, 0).astype(kind)
        del nxt
        new = np.lexsort((key, rank[who]))
        who, key = who[new], key[new]
        del new
        order[at] = who
        old = rank[who]
        first = np.r_[True, (old[1:] != old[:-1]) | (key[1:] != key[:-1])]
        del old, key
        head[at] = first
        rank[who] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        width *= 2
        if len(levels) < KEPT:
            levels.append(rank.copy())
    lcp = np.zeros(n, kind)
    live = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]]).astype(kind)
    x, y, got = order[live], order[live + 1], np.zeros(len(live), kind)
    top = 1 << (len(levels) - 1)
    for level in range(len(levels) - 1, -1, -1):
        p, q = x + got, y + got
        ok = (p < ends[x]) & (q < ends[y])
        np.minimum(p, n - 1, out=p)
        np.minimum(q, n - 1, out=q)
        got += (ok & (levels[level][p] == levels[level][q])).astype(kind) * kind(1 << level)
    lcp[live + 1] = got
    deep = np.flatnonzero(got >= 2 * top - 1)
    del levels, rank
    if len(deep):
        lcp[live[deep] + 1] = _deep(symbols, ends, x[deep], y[deep], 2 * top - 1)
    return order, lcp


def _deep(symbols: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Common prefixes, ``least`` or more, of the suffixes x and y.

    Goes through the text by y: where the start before is here as well, the
    common prefix is shorter than its by one at most.
    """
    out = np.zeros(len(x), x.dtype)
    at, size = -2, 0
    by_text = np.argsort(y, kind="stable")
    for k, a, b in zip(by_text.tolist(), x[by_text].tolist(), y[by_text].tolist(), strict=True):
        size = max(least, size - 1) if b == at + 1 else least
        most, step = min(int(ends[a]) - a, int(ends[b]) - b), 32
        while size < most:
            if symbols[a + size] != symbols[b + size]:
                break
            z = min(step, most - size)
            differ = np.flatnonzero(symbols[a + size : a + size + z] != symbols[b + size : b + size + z])
            if len(differ):
                size += int(differ[0])
                break
            size += z
            step *= 4
        out[k], at = size, b
    return out


def intervals(lcp: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(height, first row, last row)`` of the intervals of ``least`` or more, by a stack over the rows that have such prefixes."""
    heights, firsts, lasts = [], [], []
    stack: list[tuple[int, int]] = []  # (height, first row)
    rows = np.flatnonzero(lcp >= least)
    before = -1
    for row, h in zip([*rows.tolist(), -1], [*lcp[rows].tolist(), 0], strict=True):
        if row != before + 1 or row < 0:
            for height, start in stack:
                heights.append(height)
                firsts.append(start)
                lasts.append(before)
            stack = []
        start = row - 1
        while stack and stack[-1][0] > h:
            height, start = stack.pop()
            heights.append(height)
            firsts.append(start)
            lasts.append(row - 1)
        if h and (not stack or stack[-1][0] < h):
            stack.append((h, start))
        before = row
    return np.array(heights, np.int64), np.array(firsts, np.int64), np.array(lasts, np.int64)


def maximal(symbols: np.ndarray, order: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which intervals can't be extended to the left: their suffixes have different words before them, or none (at ``starts``)."""
    left = np.where(order > 0, symbols[order - 1], -1)
    left = np.where(starts[order], -1 - order, left)
    change = np.cumsum(np.r_[False, left[1:] != left[:-1]]) if len(left) else np.zeros(0, np.int64)
    return change[lasts] > change[firsts]


def longest_from(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position the length of the longest repeated substring that starts there."""
    out = np.zeros(len(order), lcp.dtype)
    out[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return out


def maximal_repeats(words: list, min_words: int = 1) -> list[tuple[int, list[int]]]:
    """``(length, starts)`` of every maximal repeated substring of one text."""
    known: dict = {}
    symbols = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    order, lcp = suffix_order(symbols, np.full(len(words), len(words)))
    height, first, last = intervals(lcp, min_words)
    starts = np.zeros(len(words), bool)
    starts[:1] = True
    keep = maximal(symbols, order, first, last, starts)
    return sorted((h, sorted(order[a : b + 1].tolist())) for h, a, b in zip(height[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True))


def _words(text: str, known: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words; a long text is never held as a list of words."""
    out, a = [], 0
    while a < len(text) or not out:
        b = a + READ
        while b < len(text) and text[b] not in common.SPACE:
            b += 1
        out.append(np.array([known.setdefault(w, len(known)) for w in text[a:b].encode().split()], np.int32))
        a = b
    return np.concatenate(out)


def _lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


class Signals:
    """All signals of a list of texts."""

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_repeats")

    def __init__(self, min_repeat: int = MIN_REPEAT, chunk: int = CHUNK_WORDS):
        self.min_repeat, self.chunk = min_repeat, chunk

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray]:
        out = {k: np.zeros(len(texts), np.int64) for k in self.names}
        for i, t in enumerate(texts):
            raw = t.encode()
            out["word_chars"][i] = len(t) - sum(map(t.count, common.SPACE))
            out["n_symbols"][i] = sum(map(t.count, SYMBOLS))
            out["n_dup_lines"][i] = _lines(raw) if b"\n" in raw else 0
        a, load, lists, known = 0, 0, [], {}
        for i, t in enumerate(texts):
            lists.append(_words(t, known))
            load += len(lists[-1])
            if load >= self.chunk or i == len(texts) - 1:
                self._repeats(lists, len(known), a, out)
                a, load, lists, known = i + 1, 0, [], {}
        return out

    def _repeats(self, lists: list[np.ndarray], n_known: int, a: int, out: dict) -> None:
        lens = np.array([len(x) for x in lists], np.int64)
        out["n_words"][a : a + len(lists)] = lens
        n = int(lens.sum())
        if not n:
            return
        doc = np.repeat(np.arange(len(lists), dtype=np.int32), lens)
        last = np.cumsum(lens)
        symbols = np.concatenate(lists).astype(np.int64) if len(lists) > 1 else lists[0]
        if len(lists) > 1:
            symbols += doc.astype(np.int64) * n_known
        starts = np.zeros(n, bool)
        starts[(last - lens)[lens > 0]] = True
        order, lcp = suffix_order(symbols, last[doc])
        height, low, high = intervals(lcp, self.min_repeat)
        whole = maximal(symbols, order, low, high, starts)
        owner = doc[order[low]]
        longest = longest_from(order, lcp)
        del order, lcp

        def covered(least: int, size: int = 0) -> np.ndarray:
            """Words inside repeats of ``least`` words or more, of which the first ``size`` count if that is given."""
            at = np.flatnonzero(longest >= least)
            return np.bincount(doc[self._marked(n, at, at + (size or longest[at]))], minlength=len(lists))

        own = slice(a, a + len(lists))
        out["n_repeat_words"][own] = covered(3, 3)
        out["n_covered"][own] = covered(self.min_repeat)
        best = np.zeros(len(lists), np.int64)
        np.maximum.at(best, doc, longest)
        out["longest_repeat"][own] = best
        out["n_repeats"][own] = np.bincount(owner[whole], minlength=len(lists))

    @staticmethod
    def _marked(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        mark = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Signals and verdict of every document.

    ``n_covered`` words lie in repeats of ``min_repeat`` words or more,
    ``longest_repeat`` is the longest repeat of any length, ``n_repeats`` the
    number of maximal repeats of ``min_repeat`` words or more.  Null and empty texts have no words, so they fail the
    base rule (fewer than 50 words).  Rows are judged one by one: repeated
    rows, ids or nulls change nothing.
    """
    names = Signals.names

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Signals(min_repeat)(batch.column(1).to_pylist())
        failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        kept = ~failed & (s["n_covered"] <= max_covered * s["n_words"] + 1e-9) & (s["longest_repeat"] <= max_repeat)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[k]) for k in names), pa.array(failed), pa.array(kept)], names=["doc_id", *names, "base_failed", "kept"])

    return common.map_batches(common.texts(docs), run, "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean")
