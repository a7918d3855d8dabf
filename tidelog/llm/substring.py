"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``size`` consecutive words of a document.  Its minimiser is the
smallest hash among its runs of ``m`` words, so equal windows have equal
minimisers, and consecutive windows mostly share theirs.  Such a run of
windows travels once, as one packed string (a super-k-mer of ``size - 1 + k``
words for ``k`` windows), to the bucket of its minimiser.  All occurrences of
a window thus meet in one bucket, where sorting finds the first one exactly.

What keeps hot groups apart: a super-k-mer that occurs again in the same
Arrow batch is judged on the spot and doesn't travel, so a passage that a
third of all documents share sends one string for each batch; runs are cut
after ``MAX_RUN`` windows, so one word repeated a million times folds the
same way; there are many more buckets than tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

M = 4
MAX_RUN = 64
#: Documents are packed in chunks of about this many words.
CHUNK_WORDS = 2_000_000
#: Characters of texts for each bucket, and for each task that judges buckets, at most about.
BUCKET_CHARS, TASK_CHARS = 1 << 20, 64 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` consecutive elements for each start; order matters. Doubling: log2(size) passes."""
    out, done, power, width = None, 0, h, 1
    while True:
        if size & width:
            out = power if out is None else _mix(out[: len(out) - width] * _B + power[done : done + len(out) - width]) if len(out) > width else out[:0]
            done += width
        if done == size:
            return out
        power = _mix(power[: max(0, len(power) - width)] * _A + power[width:])
        width *= 2


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[: max(0, len(x) - width)], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[: max(0, len(x) - rest)], x[rest:]) if rest else x


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxh64_intdigest(w) for w in words], np.uint64)


class _Packed:
    """Super-k-mers in one blob: lengths, positions and the strings, compressed."""

    @staticmethod
    def pack(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, zip_: zstandard.ZstdCompressor) -> bytes:
        head = np.array([len(pieces)], "<i8").tobytes() + docs.astype("<i8").tobytes() + starts.astype("<i4").tobytes() + counts.astype("<i4").tobytes()
        return zip_.compress(head + b"\n".join(pieces))

    @staticmethod
    def unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        docs = np.frombuffer(raw, "<i8", n, 8)
        starts = np.frombuffer(raw, "<i4", n, 8 + 8 * n)
        counts = np.frombuffer(raw, "<i4", n, 8 + 12 * n)
        return raw[8 + 16 * n :].split(b"\n"), docs, starts, counts


def _runs(ids: list[int], texts: list[bytes], size: int, buckets: int):
    """Rows ``(bucket, doc_id, blob)`` of one chunk; bucket -1: windows of doc_id known to be repeats."""
    lists = [t.split() for t in texts]
    use = [i for i in range(len(lists)) if len(lists[i]) >= size]
    if not use:
        return
    words = [w for i in use for w in lists[i]]
    norm = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    lens = np.array([len(lists[i]) for i in use], np.int64)
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    owner = np.repeat(np.arange(len(use)), lens)
    mins = _sliding_min(_rolled(_hashes(words), M), size - M + 1)  # one for each window start of the whole chunk
    del words, lists
    n = len(mins)
    valid = owner[:n] == owner[size - 1 : size - 1 + n]
    pos = np.arange(n)
    new = valid.copy()
    new[1:] &= ~((mins[1:] == mins[:-1]) & valid[:-1] & (owner[1:n] == owner[: n - 1]))
    start = np.flatnonzero(new)
    run = np.cumsum(new) - 1  # of valid windows
    count = np.bincount(run[valid], minlength=len(start))
    if len(count) and count.max() > MAX_RUN:  # cut long runs
        new |= valid & ((pos - start[np.maximum(run, 0)]) % MAX_RUN == 0)
        start = np.flatnonzero(new)
        count = np.bincount((np.cumsum(new) - 1)[valid], minlength=len(start))
    bucket = (mins[start] % np.uint64(buckets)).astype(np.int64)
    doc = np.array(ids, np.int64)[np.array(use)[owner[start]]]
    at = start - first[owner[start]]
    order = np.lexsort((at, doc, bucket))
    start, count, bucket, doc, at = start[order], count[order], bucket[order], doc[order], at[order]
    low, high = begins[start].tolist(), ends[start + count + size - 2].tolist()
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    zip_ = zstandard.ZstdCompressor(level=3)
    gone: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)], strict=True):
        seen: dict[bytes, int] = {}
        for k in range(a, b):
            piece = norm[low[k] : high[k]]
            j = seen.setdefault(piece, k)
            if j != k and (doc[j], at[j]) != (doc[k], at[k]):
                gone.setdefault(int(doc[k]), []).append((int(at[k]), int(count[k])))
        keep = np.fromiter(seen.values(), np.int64, len(seen))
        yield int(bucket[a]), None, _Packed.pack(list(seen), doc[keep], at[keep], count[keep], zip_)
    for d, windows in gone.items():
        yield -1, d, np.array(windows, "<i4").tobytes()


def _judge(blobs: list[bytes], size: int) -> list[tuple[int, bytes]]:
    """``(doc_id, windows)`` of the windows in one bucket that start earlier elsewhere."""
    pieces, docs, starts, counts = [], [], [], []
    for b in blobs:
        p, d, s, c = _Packed.unpack(b)
        pieces += p
        docs.append(d)
        starts.append(s)
        counts.append(c)
    doc, at, count = np.concatenate(docs), np.concatenate(starts).astype(np.int64), np.concatenate(counts).astype(np.int64)
    order = np.lexsort((at, doc))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seen: dict[bytes, int] = {}
    gone, keep = [], []
    for k in order.tolist():
        j = seen.setdefault(pieces[k], k)
        if j == k:
            keep.append(k)
        elif doc[j] != doc[k] or at[j] != at[k]:
            gone.append(k)
    if gone:
        g = np.array(gone)
        out.append((doc[g], at[g], count[g]))
    k = np.array(keep)
    text = b" ".join([pieces[i] for i in keep])
    del pieces, seen
    words = text.split(b" ")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    hashes = _rolled(_hashes(words), size)
    del words
    lens = count[k] + size - 1
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    owner = np.repeat(np.arange(len(k)), count[k])
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count[k]) - count[k], count[k])
    place = first[owner] + inner  # of each window, in the order of (doc, start)
    h = hashes[place]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    if len(same):
        late: list[int] = []
        groups = np.split(same, np.flatnonzero(np.diff(same) > 1) + 1)
        for g in groups:
            known: dict[bytes, int] = {}
            for w in order[g[0] : g[-1] + 2].tolist():
                p = int(place[w])
                j = known.setdefault(text[begins[p] : ends[p + size - 1]], w)
                a, b = k[owner[j]], k[owner[w]]
                if j != w and (doc[a] != doc[b] or at[a] + inner[j] != at[b] + inner[w]):
                    late.append(w)
        if late:
            w = np.sort(np.array(late))
            out.append((doc[k[owner[w]]], at[k[owner[w]]] + inner[w], np.ones(len(w), np.int64)))
    if not out:
        return []
    d, s, c = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((s, d))
    d, s, c = d[order], s[order], c[order]
    head = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (s[1:] > s[:-1] + c[:-1])])  # join windows that touch
    tail = np.r_[head[1:], len(d)] - 1
    d, s, c = d[head], s[head], s[tail] + c[tail] - s[head]
    cut = np.flatnonzero(np.diff(d)) + 1
    return [(int(d[a]), np.stack([s[a:b], c[a:b]], 1).astype("<i4").tobytes()) for a, b in zip(np.r_[0, cut], np.r_[cut, len(d)], strict=True)]


def repeated_windows(docs: DataFrame, size: int = 20, buckets: int | None = None) -> DataFrame:
    """``(doc_id, windows binary)``: runs of windows that start earlier elsewhere, as pairs of little-endian ints (first start, windows).

    A document may have several rows.  The number of buckets follows the size
    of the texts unless given, so that a bucket stays small however many there
    are; so does the number of tasks that judge them.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    n = buckets or min(2**30, max(16 * tasks, chars // BUCKET_CHARS))
    tasks = max(tasks, chars // TASK_CHARS)

    def pack(batch: pa.RecordBatch):
        ids, texts = batch.column(0).to_pylist(), common.as_bytes(batch.column(1))
        a, load = 0, 0
        for b in range(len(ids)):
            load += len(texts[b]) // 6
            if load >= CHUNK_WORDS or b == len(ids) - 1:
                rows = list(_runs(ids[a : b + 1], texts[a : b + 1], size, n))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "doc_id", "blob"])
                a, load = b + 1, 0

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            return pdf[["doc_id", "blob"]].rename(columns={"blob": "windows"})
        found = _judge(pdf["blob"].tolist(), size)
        return pd.DataFrame({"doc_id": [x[0] for x in found], "windows": [x[1] for x in found]})

    source = common.texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(common.NULL_ID)))
    packed = common.map_batches(source, pack, "bucket int, doc_id long, blob binary")
    # What is judged already only passes through; it is dealt by document, in rows of its own.
    keyed = packed.withColumn("part", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("doc_id"), F.lit(n))).otherwise(F.col("bucket")))
    return keyed.repartition(tasks, "part").groupBy("part").applyInPandas(judge, "doc_id long, windows binary")


def _cover(n_words: int, size: int, runs: list[bytes] | None) -> np.ndarray | None:
    if not runs:
        return None
    w = np.frombuffer(b"".join(runs), "<i4").reshape(-1, 2).astype(np.int64)
    mark = np.zeros(n_words + 1, np.int64)
    np.add.at(mark, np.minimum(w[:, 0], n_words), 1)
    np.add.at(mark, np.minimum(w[:, 0] + w[:, 1] + size - 1, n_words), -1)
    return np.cumsum(mark[:-1]) > 0


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)``: each document without the words of windows seen before.

    A window is removed where its word sequence also starts earlier: in a
    document of smaller id, or in the same document.  Windows are judged on
    the input.  Kept words are joined by one space.  Null and empty texts have
    no words; texts of fewer than ``size`` words keep all.  Rows that repeat
    an id and a text are one document and repeat in the result; rows without
    id come before all others, as one document; rows that repeat an id with
    other texts share their removals.
    """
    spark = docs.sparkSession
    found = common.materialised(repeated_windows(docs, size), spark, "repeats")
    runs = found.groupBy("doc_id").agg(F.collect_list("windows").alias("runs")).withColumnRenamed("doc_id", "run_id")
    source = common.texts(docs)
    joined = source.join(runs, F.coalesce("doc_id", F.lit(common.NULL_ID)) == F.col("run_id"), "left").select("doc_id", "text", "runs")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for text, r in zip(common.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            gone = _cover(len(words), size, r)
            n_words.append(len(words))
            n_removed.append(0 if gone is None else int(gone.sum()))
            kept.append(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return common.map_batches(joined, cut, "doc_id long, n_words long, n_removed long, text string")
