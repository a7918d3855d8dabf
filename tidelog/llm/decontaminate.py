"""Benchmark decontamination with one Aho-Corasick automaton.

A window is ``n`` consecutive words of a benchmark item (question or answer);
an item of fewer words is one window.  The automaton works on word numbers
and holds each item once, not each of its overlapping windows: an item of
``n`` words or more is laid out in blocks of ``(n + 1) // 2`` words, side by
side, and shorter items are patterns as they are.  Wherever a window begins,
it holds one of its item's blocks whole.  So a document is normalised and
scanned once; each block found proposes the few windows of the document
around it, and these are looked up in a table of all windows of the items,
where the words themselves decide.  Hit words are mapped to byte offsets of
the original text.

Only documents travel through the scan.  A benchmark of more than
``BLOCK_BYTES`` is taken in blocks, one after the other, each with an
automaton of its own; what a block finds is written as short rows, and the
rows of a document are united.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Maps A-Z to a-z, keeps 0-9, a-z and all bytes of non-ASCII characters, turns the rest into spaces.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Benchmark text that the driver, a broadcast and an automaton hold at a time.
BLOCK_BYTES = 4 << 20
#: Items are cut into overlapping parts of this many words, so that a block can keep to its size.
PART_WORDS = 20_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Windows:
    """All windows of ``size`` words in a sequence of word numbers, with their owners; looked up by hash, decided by the words."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, owners: np.ndarray, size: int):
        self.flat, self.size = flat, size
        rng = np.random.default_rng(len(flat))
        while True:  # until no two different windows share a hash
            self.by = rng.integers(0, 2**64, size, np.uint64) | np.uint64(1)
            h = self._hash(flat, starts)
            order = np.lexsort((owners, h))
            first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
            self.hash, self.at = h[order][first], starts[order][first]
            if all(np.array_equal(flat[starts[order] + k], flat[self.at[group] + k]) for k in range(size)):
                break
        owner = owners[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
        self.owner = owner[new].astype(np.int32)
        self.ends = np.cumsum(np.bincount(group[new], minlength=len(first)))

    def _hash(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        for k in range(self.size):
            h += flat[starts + k].astype(np.uint64) * self.by[k]
        return h ^ (h >> np.uint64(31))

    def find(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``starts`` where a window stands in ``words``, and the windows' numbers."""
        if not len(self.hash) or not len(starts):
            return starts[:0], starts[:0]
        k = np.minimum(np.searchsorted(self.hash, h := self._hash(words, starts)), len(self.hash) - 1)
        at = np.flatnonzero(self.hash[k] == h)
        span = np.arange(self.size)
        same = (words[starts[at][:, None] + span] == self.flat[self.at[k[at]][:, None] + span]).all(axis=1)
        return starts[at[same]], k[at[same]]

    def owners(self, window: int) -> np.ndarray:
        return self.owner[self.ends[window - 1] if window else 0 : self.ends[window]]


class Automaton:
    """Finds all windows of items in normalised text."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = 13):
        self.n, self.block = n, (n + 1) // 2
        self.names = [item for item, _ in items]
        self.number: dict[bytes, int] = {}
        lists = [[self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)] for _, text in items]
        self.short: dict[tuple[int, ...], set[int]] = {}
        flat: list[int] = []
        starts: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        patterns: dict[tuple[int, ...], int] = {}
        for k, words in enumerate(lists):
            if not words:
                continue
            if len(words) < n:
                self.short.setdefault(tuple(words), set()).add(k)
                patterns[tuple(words)] = len(words)
                continue
            starts.append(np.arange(len(flat), len(flat) + len(words) - n + 1))
            owners.append(np.full(len(words) - n + 1, k))
            flat += words
            for a in range(0, len(words) - self.block + 1, self.block):
                patterns[tuple(words[a : a + self.block])] = self.block
        none = [np.zeros(0, np.int64)]
        self.windows = Windows(np.array(flat, np.int64), np.concatenate(starts or none), np.concatenate(owners or none), n)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for words, size in patterns.items():
            self.automaton.add_word(words, size)
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str], bool]:
        """The number of words, the hit words' numbers in order, the items found, and whether a window of ``n`` words is among them."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), np.zeros(0, np.int64), set(), False
        ids = tuple(map(self.number.get, words, repeat(0)))
        mark, items, around = None, set(), []
        for end, size in self.automaton.iter(ids):
            if mark is None:
                mark = np.zeros(len(words) + 1, np.int64)
            a = end - size + 1
            owners = self.short.get(ids[a : end + 1])
            if owners:
                mark[a] += 1
                mark[end + 1] -= 1
                items |= owners
            if size == self.block:
                around.append(end)
        full = False
        if around:
            last = np.array(around)
            starts = np.unique((last[:, None] - np.arange(self.block - 1, self.n)).ravel())  # windows that hold the block
            starts = starts[(starts >= 0) & (starts <= len(words) - self.n)]
            found, which = self.windows.find(np.array(ids, np.int64), starts)
            full = len(found) > 0
            np.add.at(mark, found, 1)
            np.add.at(mark, found + self.n, -1)
            for w in np.unique(which).tolist():
                items.update(self.windows.owners(w).tolist())
        if mark is None:
            return len(words), np.zeros(0, np.int64), set(), False
        return len(words), np.flatnonzero(np.cumsum(mark[:-1]) > 0), {self.names[k] for k in items}, full


def spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the original text that runs of hit words cover."""
    if not len(hit):
        return []
    flat = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], flat.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = np.flatnonzero(np.diff(hit) > 1)
    return [(int(starts[a]), int(ends[b])) for a, b in zip(hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]], strict=True)]


def _automaton(items: list[tuple[str, bytes]], n: int, key: str) -> Automaton:
    """One automaton a worker process, built at its first batch."""
    return common.worker_state("benchmark", (key, n), lambda: Automaton(items, n))


def _parts(benchmark: DataFrame, item_col: str, n: int) -> DataFrame:
    """``(item, words)`` of all items: normalised, the long ones in parts that overlap by ``n - 1`` words."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, parts = [], []
        for item, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
            words = words_of(text)
            for a in range(0, max(1, len(words) - n + 1) if words else 0, PART_WORDS):
                names.append(item)
                parts.append(b" ".join(words[a : a + PART_WORDS + n - 1]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], names=["item", "words"])

    return common.map_batches(items, run, "item string, words binary").distinct()


def _blocks(benchmark: DataFrame, item_col: str, n: int, block_bytes: int):
    """``(items, key)`` of each block of the benchmark, one after the other."""
    parts = _parts(benchmark, item_col, n)
    total = parts.agg(F.coalesce(F.sum(F.length("words") + F.length("item")), F.lit(0))).first()[0]
    count = int(total // block_bytes) + 1
    for k in range(count):
        own = parts if count == 1 else parts.where(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == k)
        items = sorted((r["item"], bytes(r["words"])) for r in own.collect())
        yield count, items, hashlib.sha256(repr(items).encode()).hexdigest()


_FOUND = "doc_id long, n_words long, hit_words array<int>, hit_spans array<array<int>>, items array<string>"


def _row(text: bytes, n_words: int, hit: np.ndarray, items) -> tuple:
    return n_words, hit.tolist(), [list(s) for s in spans(text, hit)], sorted(items)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()))
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id") -> DataFrame:
    """``(doc_id, n_words, hit_words array<int>, hit_spans array<array<int>>, items array<string>)`` of each row.

    ``hit_words`` are the numbers of the words inside an occurrence of a
    window, ``hit_spans`` the byte spans that they cover in the original text,
    ``items`` the items that own such windows, sorted as strings.  Null and
    empty texts have no words; items without words or id have no windows;
    items that repeat count once.
    """
    spark = docs.sparkSession
    rows = common.texts(docs)
    keyed = rows.select("doc_id", "text", F.sha2("text", 256).alias("key"))
    found = []
    for count, items, key in _blocks(benchmark, item_col, n, block_bytes):
        sent = spark.sparkContext.broadcast(items)
        if count == 1:

            def whole(batch: pa.RecordBatch, sent=sent, key=key) -> pa.RecordBatch:
                auto, texts = _automaton(sent.value, n, key), common.as_bytes(batch.column(1))
                out = [_row(t, *auto.scan(t)[:3]) for t in texts]
                return pa.RecordBatch.from_arrays([batch.column(0), *_columns(out)], names=["doc_id", "n_words", "hit_words", "hit_spans", "items"])

            return common.map_batches(rows, whole, _FOUND, "benchmark")
        found.append(common.materialised(_hits(keyed, sent, n, key), spark, "benchmark-hits"))
        sent.destroy()
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    one = hits.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    one = common.materialised(one, spark, "benchmark-hits")  # written out, so that the join can split a text that very many rows share
    joined = keyed.join(one, "key", "left").select("doc_id", "text", "hits", "items")

    def unite(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, hit, items in zip(common.as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            out.append(_row(t, len(words_of(t)), np.array(sorted(hit or []), np.int64), items or []))
        return pa.RecordBatch.from_arrays([batch.column(0), *_columns(out)], names=["doc_id", "n_words", "hit_words", "hit_spans", "items"])

    return common.map_batches(joined, unite, _FOUND, "benchmark")


def _hits(keyed: DataFrame, sent, n: int, key: str) -> DataFrame:
    """``(key, hits, items, full)`` of the texts in which a block of the benchmark is found; equal texts give one row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto = _automaton(sent.value, n, key)
        at, hits, items, full = [], [], [], []
        for k, t in enumerate(common.as_bytes(batch.column(1))):
            _, hit, own, whole = auto.scan(t)
            if len(hit):
                at.append(k)
                hits.append(hit.tolist())
                items.append(sorted(own))
                full.append(whole)
        return pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(at, pa.int64())), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(full, pa.bool_())], names=["key", "hits", "items", "full"])

    return common.map_batches(keyed, run, "key string, hits array<int>, items array<string>, full boolean", "benchmark").dropDuplicates(["key"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """One row for each document: counts, a digest of the items found, and the verdict.

    ``contaminated`` holds where some word is hit and hit words are at least a
    twentieth of all words.
    """
    found = contamination(docs, benchmark, n)
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def _dirty(n_words: int, n_hit: int, full: bool) -> bool:
    return full or n_hit > 0 and 20 * n_hit >= n_words


def reject(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs``, all columns, without those that leak the benchmark.

    A document goes if it holds a window of ``n`` words anywhere, however long
    it is.  Items of fewer words are often plain phrases; for them a document
    goes if a twentieth of its words stand in hits.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = []
    for count, items, key in _blocks(benchmark, "item_id", n, block_bytes):
        sent = spark.sparkContext.broadcast(items)
        if count == 1:

            def clean(texts: list[bytes], sent=sent, key=key) -> list[bool]:
                auto = _automaton(sent.value, n, key)
                return [not _dirty(n_words, len(hit), full) for n_words, hit, _, full in map(auto.scan, texts)]

            return common.keep_rows(docs, clean, owner="benchmark")
        found.append(common.materialised(_hits(docs.select(F.lit(0).alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("key")), sent, n, key).drop("items"), spark, "benchmark-hits"))
        sent.destroy()
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    one = hits.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.max("full").alias("full")).select(F.col("key").alias("__key"), F.size("hits").alias("__n_hit"), F.col("full").alias("__full"))
    one = common.materialised(one, spark, "benchmark-hits")
    suspects = docs.join(one, F.sha2(text, 256) == F.col("__key"), "left")
    width, at, n_hit, full = len(docs.columns), *(suspects.columns.index(c) for c in ("text", "__n_hit", "__full"))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(common.as_bytes(batch.column(at)), batch.column(n_hit).to_pylist(), batch.column(full).to_pylist(), strict=True)
        keep = pa.array([not (h and _dirty(len(words_of(t)), h, f)) for t, h, f in rows], pa.bool_())
        return batch.select(list(range(width))).filter(keep)

    return common.map_batches(suspects, judge, docs.schema, "benchmark")
