"""N-best segmentation over a SentencePiece lattice, and decoding.

The lattice of a text has an edge for every piece of the model that occurs at
a place, with the piece's score; a character that no piece covers alone gets
one edge with a penalty, spelled in byte pieces.  A forward Viterbi pass
gives each position the best score of reaching it.  These scores are exact
heuristics for a backward A* search, which therefore yields complete paths in
the order of their scores and expands nothing else.

Pieces never go from a non-space over to a space, nor over a line break, so
a text's lattice falls into units (a run of spaces and the word after it)
that meet in single positions.  Units repeat a lot and are solved once for
each worker process.  A text's N best paths differ from the best one only in
the N - 1 units that lose least by their second path; A* runs on those alone.

Equal scores are put in order by the starts of the pieces over the whole text,
read from its end: at the last piece in which two paths differ, the longer
one comes first.  Scores are sums of single-precision numbers and so exact in
practice.  A word without any space, however long, is one unit; time and
memory are linear in it.  With a model whose scores are merge ranks the
best path is the one of the smallest rank sum, which can differ from the
pieces that merging would make; decoding gives the same text.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from bisect import bisect_right
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Solved units kept by a worker process: twice as many at most, in a young and an old generation.
MEMO = 150_000
#: Texts solved and sent on together.
TEXTS = 500
#: Pieces of this score or less (space runs of some models) count as given, but not for the penalty of unknown characters.
NEVER = -1e8
UNKNOWN = 10.0
_LOW = float("-inf")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Piece table of a model file with byte fallback and no normalisation of its own."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.decode(sp.encode("ﬁ ①")) != "ﬁ ①":
            raise ValueError("the model rewrites texts; only models that keep them can be decoded exactly")
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_ = {int(names[i][3:-1], 16): i for i in range(len(names)) if sp.is_byte(i)}
        plain = [i for i in range(len(names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = [sp.get_score(i) for i in plain]
        self.unknown = min((s for s in scores if s > NEVER), default=0.0) - UNKNOWN
        #: Every piece, and with () every beginning of one that is no piece itself.
        self.trie: dict[str, tuple[int, float] | tuple[()]] = {}
        for i, s in zip(plain, scores, strict=True):
            for k in range(1, len(names[i])):
                self.trie.setdefault(names[i][:k], ())
            self.trie[names[i]] = (i, s)
        spelled = [b""] * len(names)
        for i in plain:
            spelled[i] = names[i].replace(SPACE, " ").encode()
        for b, i in self.bytes_.items():
            spelled[i] = bytes([b])
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; the space that encoding put in front is taken off."""
        size = self.size[ids]
        total = int(size.sum())
        place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(self.at[ids], size) + place].tobytes()[1:]


def solve(pieces: Pieces, unit: str) -> tuple[list[int], float, float]:
    """Ids and score of a unit's best path, and how much the second best loses (infinite if there is none).

    The second best path has an edge that isn't on the best one, so it is the
    best among the best paths through each such edge, which the forward and
    backward scores tell.
    """
    text = unit.replace(SPACE, "\0").replace(" ", SPACE)  # a literal mark is a character like any unknown one
    get, n = pieces.trie.get, len(text)
    forward, back = [0.0, *[_LOW] * n], [0] * (n + 1)
    edges = []
    for b in range(n):
        f, first = forward[b], len(edges)
        for e in range(b + 1, n + 1):
            hit = get(text[b:e])
            if hit is None:
                break
            if hit:
                s = hit[1]
                edges.append((b, e, s))
                if f + s > forward[e]:
                    forward[e] = f + s
                    back[e] = b
        if first == len(edges) or edges[first][1] > b + 1:
            edges.append((b, b + 1, pieces.unknown))
            if f + pieces.unknown > forward[b + 1]:
                forward[b + 1] = f + pieces.unknown
                back[b + 1] = b
    ids: list[int] = []
    on, e = [-1] * (n + 1), n
    while e:
        b = on[e] = back[e]
        hit = get(text[b:e])
        if hit:
            ids.append(hit[0])
        else:
            ids += [pieces.bytes_[x] for x in reversed(unit[b].encode())]
        e = b
    ids.reverse()
    backward, second = [*[_LOW] * n, 0.0], _LOW
    for b, e, s in reversed(edges):
        g = s + backward[e]
        if g > backward[b]:
            backward[b] = g
        g += forward[b]
        if g > second and on[e] != b:
            second = g
    return ids, forward[n], forward[n] - second


class Table:
    """The trie of the pieces in arrays, to solve many units of one length side by side.

    A node is a beginning of a piece; the step from a node over a character is
    looked up in an open hash table.  Gives what :func:`solve` gives, with the
    same sums in the same order.
    """

    LONG, FEW = 24, 24  # longer units, and lengths with fewer units, go to solve()

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        names = sorted(pieces.trie, key=len)
        number = {"": 0} | {x: i for i, x in enumerate(names, 1)}
        chars = sorted({x[-1] for x in names})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.code[ord(" ")], self.code[ord(SPACE)] = self.code[ord(SPACE)], self.code[0]
        of_char = {c: i for i, c in enumerate(chars, 1)}
        self.width = np.int64(len(chars) + 1)
        bits = (4 * len(names)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys = np.array([number[x[:-1]] * int(self.width) + of_char[x[-1]] for x in names], np.int64)
        for k, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True), 1):
            while self.key[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.key[slot], self.to[slot] = key, k
        hits = [(-1, 0.0), *(pieces.trie[x] or (-1, 0.0) for x in names)]
        self.piece, self.score = np.array([h[0] for h in hits], np.int32), np.array([h[1] for h in hits])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes one character further, 0 where there is none."""
        key = node * self.width + code
        slot = self._slot(key)
        found = self.key[slot]
        out = np.where(found == key, self.to[slot], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.key[slot[open_]]
            same = found == key[open_]
            out[open_[same]] = self.to[slot[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out.astype(np.int64)

    def solve(self, units: list[str]) -> list[tuple[bytes, float, float]]:
        """Packed ids, score and loss of the second best path of each unit."""
        out: list = [None] * len(units)
        by_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_length.setdefault(len(u), []).append(i)
        for n, rows in by_length.items():
            found = self._solve(n, [units[i] for i in rows]) if self.FEW <= len(rows) and n <= self.LONG else [None] * len(rows)
            for i, x in zip(rows, found, strict=True):
                out[i] = x or _packed(self.pieces, units[i])
        return out

    def _solve(self, n: int, units: list[str]) -> list[tuple[bytes, float, float] | None]:
        """Units of ``n`` characters; None where the best path has an unknown character."""
        m, unknown = len(units), self.pieces.unknown
        code = np.ascontiguousarray(self.code[np.frombuffer("".join(units).encode("utf-32-le"), "<u4").reshape(m, n).T])
        forward, back, piece = np.full((n + 1, m), _LOW), np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.int32)
        forward[0] = 0.0
        edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []

        def relax(b: int, e: int, who: np.ndarray, s: np.ndarray, p: np.ndarray) -> None:
            got = forward[b, who] + s
            better = got > forward[e, who]
            w = who[better]
            forward[e, w], back[e, w], piece[e, w] = got[better], b, p[better]
            edges.append((b, e, who, s))

        everyone = np.arange(m)
        for b in range(n):
            who, node = everyone, np.zeros(m, np.int64)
            for e in range(b + 1, n + 1):
                node = self._next(node, code[e - 1, who])
                p = self.piece[node]
                if e == b + 1:
                    alone = who[p < 0]
                hit = np.flatnonzero(p >= 0)
                if len(hit):
                    relax(b, e, who[hit], self.score[node[hit]], p[hit])
                live = np.flatnonzero(node)
                if not len(live):
                    break
                who, node = who[live], node[live]
            if len(alone):
                relax(b, b + 1, alone, np.full(len(alone), unknown), np.full(len(alone), -1, np.int32))
        on, at, live, steps = np.full((n + 1, m), -1, np.int64), np.full(m, n), everyone, []
        while len(live):
            e = at[live]
            b = on[e, live] = back[e, live]
            steps.append((live, piece[e, live]))
            at[live] = b
            live = live[b > 0]
        size = np.zeros(m, np.int64)
        for live, _ in steps:
            size[live] += 1
        end = np.cumsum(size)
        flat, whole = np.zeros(int(end[-1]), "<i4"), np.ones(m, bool)
        for k, (live, p) in enumerate(steps):
            flat[end[live] - 1 - k] = p
            whole[live[p < 0]] = False
        backward, second = np.full((n + 1, m), _LOW), np.full(m, _LOW)
        backward[n] = 0.0
        for b, e, who, s in reversed(edges):
            g = s + backward[e, who]
            backward[b, who] = np.maximum(backward[b, who], g)
            other = on[e, who] != b
            w = who[other]
            second[w] = np.maximum(second[w], (g + forward[b, who])[other])
        raw, ends = flat.tobytes(), (4 * end).tolist()
        return [(raw[a:z], s, gap) if ok else None for a, z, s, gap, ok in zip([0, *ends[:-1]], ends, forward[n].tolist(), (forward[n] - second).tolist(), whole.tolist(), strict=True)]


def _packed(pieces: Pieces, unit: str) -> tuple[bytes, float, float]:
    ids, score, gap = solve(pieces, unit)
    return struct.pack(f"<{len(ids)}I", *ids), score, gap


class Lattice:
    """All pieces of one unit, by their ends: ``into[e]`` has ``(start, piece)`` in the order of the starts; no piece: an unknown character."""

    OPEN = 64  # paths held before those that can't be among the best are left out

    def __init__(self, pieces: Pieces, unit: str):
        self.pieces, self.unit = pieces, unit
        text = unit.replace(SPACE, "\0").replace(" ", SPACE)
        get, self.n = pieces.trie.get, len(text)
        self.into: list[list[tuple[int, tuple | None]]] = [[] for _ in range(self.n + 1)]
        self.forward = forward = [0.0, *[_LOW] * self.n]
        for b in range(self.n):
            alone = False
            for e in range(b + 1, self.n + 1):
                hit = get(text[b:e])
                if hit is None:
                    break
                if hit:
                    alone |= e == b + 1
                    self.into[e].append((b, hit))
                    forward[e] = max(forward[e], forward[b] + hit[1])
            if not alone:
                self.into[b + 1].append((b, None))
                forward[b + 1] = max(forward[b + 1], forward[b] + pieces.unknown)

    def nbest(self, k: int) -> list[tuple[float, tuple[int, ...], int]]:
        """``(score, ids, rank)`` of the ``k`` best paths by backward A*; ``rank`` is a path's place by starts alone.

        The open paths stand in the order of their starts; a path gives its
        place to its extensions.  As the heuristic is exact, each open path
        leads to a whole one of its own, of just the score it promises, so no
        more of them are kept than paths are wanted.  A path is a chain of
        links to what it was extended from.
        """
        forward, into, unknown = self.forward, self.into, self.pieces.unknown
        promised = [forward[self.n]]  # of the open paths, in the order of their starts; whole ones stay in their places
        paths: list[tuple] = [(self.n, 0.0, None)]  # place, score so far, links
        order: list[tuple] = []
        while len(order) < k:
            best = max(promised)
            if best == _LOW:
                break
            i = promised.index(best)
            at, g, links = paths[i]
            if not at:
                promised[i] = _LOW
                order.append(paths[i])
                continue
            more = [(b, g + (hit[1] if hit else unknown), ((b, hit), links)) for b, hit in into[at]]
            promised[i : i + 1] = [forward[b] + h for b, h, _ in more]
            paths[i : i + 1] = more
            if len(paths) > self.OPEN + 2 * k:
                live = sorted((i for i, f in enumerate(promised) if f != _LOW), key=lambda i: (-promised[i], i))
                gone = set(live[k - len(order) :])
                promised, paths = ([x for i, x in enumerate(y) if i not in gone] for y in (promised, paths))
        whole = {id(x) for x in order}
        rank = {x: r for r, x in enumerate(id(x) for x in paths if id(x) in whole)}
        return [(x[1], self._ids(x[2]), rank[id(x)]) for x in order]

    def second_is_early(self) -> bool:
        """Whether the second best path comes before the best one by its starts."""
        first, second = self.nbest(2)
        return second[2] < first[2]

    def _ids(self, links) -> tuple[int, ...]:
        ids: list[int] = []
        while links:
            (b, hit), links = links
            if hit:
                ids.append(hit[0])
            else:
                ids += [self.pieces.bytes_[x] for x in self.unit[b].encode()]
        return tuple(ids)


class _Solved(dict):
    """A memo in two generations; :meth:`age` starts a new one, and what isn't asked for in one goes with the next."""

    def __init__(self, solve):
        self.solve, self.old = solve, {}

    def of(self, names: list[str]) -> list:
        """What is known of each name, after finding out what isn't."""
        found = list(map(self.get, names))
        gaps = [k for k, x in enumerate(found) if x is None]
        if gaps:
            need = {names[k] for k in gaps}
            old = self.old
            kept = [x for x in need if x in old]
            self.update(zip(kept, map(old.__getitem__, kept), strict=True))
            new = list(need.difference(kept))
            self.update(zip(new, self.solve(new), strict=True))
            for k in gaps:
                found[k] = self[names[k]]
        return found

    def age(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """N best segmentations of whole texts."""

    UNIT = re.compile(" *[^ ]+| +")

    def __init__(self, path: str, n: int = 4, memo: int = MEMO):
        self.pieces, self.n, self.memo = Pieces(path), n, memo
        table = Table(self.pieces)
        self.word = _Solved(lambda words: table.solve([" " + w for w in words]))  # a word after one space
        self.other = _Solved(table.solve)
        self.early = _Solved(lambda units: [Lattice(self.pieces, u).second_is_early() for u in units])
        self.ways = _Solved(lambda units: [[(s, np.array(i, "<u4").tobytes(), r) for s, i, r in Lattice(self.pieces, u).nbest(self.n)] for u in units])

    def _cut(self, text: str, words: list[str], others: list[str]) -> list[tuple[bool, int, int]]:
        """The units of a text, put behind ``words`` (after one space, without it) or ``others``; runs of them, by list and places."""
        runs: list[tuple[bool, int, int]] = []
        for k, line in enumerate((" " + text).split("\n") if text else ()):
            at = len(others)
            if k:
                others.append("\n")
            if "  " in line:
                others += self.UNIT.findall(line)
                runs.append((False, at, len(others)))
                continue
            head, *rest = line.split(" ")
            if head:
                others.append(head)
            if len(others) > at:
                runs.append((False, at, len(others)))
            if rest:
                runs.append((True, len(words), len(words) + len(rest)))
                words += rest
        return runs

    def __call__(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """For each text ``(score, ids)`` of up to ``n`` segmentations, best first; ids as little-endian unsigned 32-bit integers."""
        self.word.age(self.memo)
        self.other.age(self.memo // 8)
        self.ways.age(self.memo // 16)
        self.early.age(self.memo // 4)
        words: list[str] = []
        others: list[str] = []
        cut = [self._cut(t, words, others) for t in texts]
        solved = self.other.of(others), self.word.of(words)
        names = others, words
        found = [self._best(runs, names, solved) for runs in cut]
        self.ways.of(list({u for *_, closest in found for _, u in closest}))
        return [self._ways(units, closest) for units, closest in found]

    def _best(self, runs: list[tuple[bool, int, int]], names: tuple, solved: tuple) -> tuple[list, list[tuple[int, str]]]:
        """A text's solved units, and the places and names of those that lose least by their second path."""
        units: list = []
        starts: list[int] = []
        for plain, a, b in runs:
            starts.append(len(units))
            units += solved[plain][a:b]
        gaps = np.fromiter(map(itemgetter(2), units), np.float64, len(units))
        few, most = np.arange(len(units)), self.n - 1
        if len(units) > most:
            few = np.flatnonzero(gaps <= np.partition(gaps, most - 1)[most - 1]) if most else few[:0]

        def name(k: int) -> str:
            run = bisect_right(starts, k) - 1
            plain, a, _ = runs[run]
            x = names[plain][a + k - starts[run]]
            return " " + x if plain else x

        few = few[np.isfinite(gaps[few])]
        if len(few) > most:  # several lose the same: those go on whose second path comes first in the text's order of ties
            last = gaps[few].max()
            sure, tied = few[gaps[few] < last].tolist(), {k: name(k) for k in few[gaps[few] == last].tolist()}
            names_ = list(set(tied.values()))
            early = dict(zip(names_, self.early.of(names_) if last else [False] * len(names_), strict=True))
            few = np.array(sure + sorted(tied, key=lambda k: (0, -k) if early[tied[k]] else (1, k))[: most - len(sure)], np.int64)
        return units, [(k, name(k)) for k in np.sort(few).tolist()]

    def _ways(self, units: list, closest: list[tuple[int, str]]) -> list[tuple[float, bytes]]:
        parts = list(map(itemgetter(0), units))
        best = sum(map(itemgetter(1), units))
        ways: list[tuple[float, tuple[tuple[int, bytes], ...]]] = [(0.0, ())]
        for k, unit in closest:  # of two paths with the same loss, the last unit in which they differ decides
            own = self.ways[unit]
            best_score = own[0][0]
            every = [(loss + (best_score - s), rank, n, change if i is own[0][1] else (*change, (k, i))) for n, (loss, change) in enumerate(ways) for s, i, rank in own]
            ways = [(loss, change) for loss, _, _, change in heapq.nsmallest(self.n, every)]
        out = []
        for loss, change in ways:
            for k, i in change:
                parts[k] = i
            out.append((best - loss, b"".join(parts)))
            for k, _ in change:
                parts[k] = units[k][0]
        return out


def _encoder(path: str, n: int) -> Encoder:
    return common.worker_state("pieces", (path, n), lambda: Encoder(path, n))


def encode(docs: DataFrame, n: int = 4, model: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>, nbest array<struct<score, ids>>, exact)`` of each row.

    ``ids`` is the best segmentation, ``nbest`` has up to ``n`` of them in the
    order of their scores, ``exact`` tells whether decoding ``ids`` gives the
    text again, byte for byte.  Null and empty texts have no ids, and one
    segmentation, of score 0.
    """
    path = model or model_path()
    nbest = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def run(batch: pa.RecordBatch):
        enc = _encoder(path, n)
        texts = batch.column(1).to_pylist()
        for a in range(0, len(texts), TEXTS):
            part = texts[a : a + TEXTS]
            found = enc(part)
            ids = [[np.frombuffer(i, "<u4").astype(np.int32) for _, i in ways] for ways in found]
            exact = [not t or enc.pieces.decode(i[0]) == t.encode() for t, i in zip(part, ids, strict=True)]
            rows = [[{"score": s, "ids": i} for (s, _), i in zip(ways, own, strict=True)] for ways, own in zip(found, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + TEXTS], pa.array([i[0] for i in ids], pa.list_(pa.int32())), pa.array(rows, nbest), pa.array(exact)], names=["doc_id", "ids", "nbest", "exact"])

    return common.map_batches(common.texts(docs), run, "doc_id long, ids array<int>, nbest array<struct<score: double, ids: array<int>>>, exact boolean", "pieces")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids array<int>)``; null ids give an empty text."""
    path = model or model_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = _encoder(path, 4).pieces
        out = [pieces.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return common.map_batches(rows.select("doc_id", "ids"), run, "doc_id long, text string", "pieces")


def digests(docs: DataFrame, n: int = 4, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_pieces, ids_crc32, nbest_scores, nbest_crc32, exact)``: :func:`encode` with digests for ids; the best ones too if asked for."""
    path = model or model_path()

    def run(batch: pa.RecordBatch):
        for a in range(0, batch.num_rows, TEXTS):
            yield part(batch.slice(a, TEXTS))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = _encoder(path, n)
        size, scores, crcs, exact, ids = [], [], [], [], []
        texts = batch.column(1).to_pylist()
        for t, ways in zip(texts, enc(texts), strict=True):
            size.append(len(ways[0][1]) // 4)
            scores.append([s for s, _ in ways])
            if with_ids:
                ids.append(np.frombuffer(ways[0][1], "<i4"))
            crcs.append([zlib.crc32(i) for _, i in ways])
            exact.append(not t or enc.pieces.decode(np.frombuffer(ways[0][1], "<u4")) == t.encode())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array([c[0] for c in crcs], pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(crcs, pa.list_(pa.int64())), pa.array(exact)] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids,
            names=["doc_id", "n_pieces", "ids_crc32", "nbest_scores", "nbest_crc32", "exact"] + ["ids"] * with_ids,
        )

    return common.map_batches(common.texts(docs), run, "doc_id long, n_pieces long, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, exact boolean" + ", ids array<int>" * with_ids, "pieces")
