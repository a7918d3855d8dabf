"""Reversible line deduplication: cuckoo filters backed by exact reference counts.

The index has two tables in the shared folder, both sharded by line key:

``refs``     (key, n_docs): how many documents hold a line, exactly.
``filters``  (shard, filter): a cuckoo filter of the keys that ``min_docs`` or
             more documents hold.  Shards grow in number with these keys, so
             none has more than about ``PER_SHARD``.

Inserting documents adds to the counts, deleting documents subtracts from
them, and keys that cross the threshold either way are put into or taken out
of their shard's filter; that is what a cuckoo filter can do and a Bloom
filter cannot.  After a deletion the index equals one that never saw the
deleted documents.  When lines are judged, the filters answer first: a line
that they don't know is unique enough and goes no further.  What passes is
joined with the exact counts, so false positives change nothing.  Filters are
sent to the executors in blocks of shards of a bounded size, one after the
other, each with the lines of its shards.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Filters that the driver holds and sends to the executors at a time.
FILTER_BYTES = 64 << 20
#: Keys of a filter, about.
PER_SHARD = 50_000


class CuckooFilter:
    """32-bit fingerprints in buckets of four, each with two possible places.

    The filter grows (doubles and is filled anew from its fingerprints' keys)
    when a key finds no place, so inserts never fail.
    """

    KICKS, SLOTS = 200, 4

    def __init__(self, buckets: int = 16):
        self.table = np.zeros((buckets, self.SLOTS), np.uint32)  # 0: a free slot
        self.size = 0

    @staticmethod
    def _mix(x: int) -> int:
        x = (x ^ (x >> 16)) * 0x45D9F3B & 0xFFFFFFFF
        return x ^ (x >> 16)

    def _places(self, h: int) -> tuple[int, int, int]:
        fp = (h & 0xFFFFFFFF) or 1
        mask = len(self.table) - 1
        i = (h >> 32) & mask
        return fp, i, (i ^ self._mix(fp)) & mask

    def insert(self, h: int) -> None:
        fp, i, j = self._places(h)
        for k in (i, j):
            free = np.flatnonzero(self.table[k] == 0)
            if len(free):
                self.table[k, free[0]] = fp
                self.size += 1
                return
        k = i
        for step in range(self.KICKS):
            slot = step % self.SLOTS
            fp, self.table[k, slot] = int(self.table[k, slot]), fp
            k = (k ^ self._mix(fp)) & (len(self.table) - 1)
            free = np.flatnonzero(self.table[k] == 0)
            if len(free):
                self.table[k, free[0]] = fp
                self.size += 1
                return
        raise OverflowError(fp)

    def delete(self, h: int) -> bool:
        fp, i, j = self._places(h)
        for k in (i, j):
            at = np.flatnonzero(self.table[k] == fp)
            if len(at):
                self.table[k, at[0]] = 0
                self.size -= 1
                return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the 64-bit hashes may be in the filter; no false negatives."""
        h = hashes.astype(np.uint64)
        fp = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        fp[fp == 0] = 1
        mask = np.uint32(len(self.table) - 1)
        i = ((h >> np.uint64(32)).astype(np.uint32)) & mask
        x = ((fp ^ (fp >> np.uint32(16))).astype(np.uint64) * np.uint64(0x45D9F3B) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        j = (i ^ (x ^ (x >> np.uint32(16)))) & mask
        return (self.table[i] == fp[:, None]).any(axis=1) | (self.table[j] == fp[:, None]).any(axis=1)

    @classmethod
    def of(cls, hashes, buckets: int = 0) -> CuckooFilter:
        """A filter of the given hashes, large enough for all of them."""
        hashes = list(hashes)
        n = buckets or 1 << max(4, (len(hashes) * 5 // 16).bit_length())
        while True:
            out = cls(n)
            try:
                for h in hashes:
                    out.insert(h)
                return out
            except OverflowError:
                n *= 2

    def to_bytes(self) -> bytes:
        return self.table.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(data, "<u4").reshape(-1, cls.SLOTS).copy()
        out.size = int((out.table != 0).sum())
        return out


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case."""
    return common.ascii_lower(F.btrim(line, F.lit(common.SPACE)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(key: Column) -> Column:
    return F.unhex(F.sha2(key, 256))


def _hash64(keys) -> np.ndarray:
    return np.array([int.from_bytes(k[:8], "big") for k in keys], np.uint64)


class LineIndex:
    """Counts of line holders that documents can be added to and taken from.

    Lines of fewer than ``min_chars`` code points (of the key) are never
    counted.  A document is what shares a ``doc_id`` within one call: rows that
    repeat an id count once for each of their lines.  An id that is inserted by
    two calls counts twice, and has to be deleted twice.  Rows without id count
    as one document, which is smaller than all others.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 5, min_chars: int = 40, shards: int = 16):
        self.spark, self.min_docs, self.min_chars, self.shards = spark, min_docs, min_chars, shards
        self.refs: DataFrame = spark.createDataFrame([], "key binary, n_docs long")
        self.filters: DataFrame = spark.createDataFrame([], "shard int, filter binary")

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")

    def postings(self, docs: DataFrame) -> DataFrame:
        """Distinct ``(doc_id, key)`` of the lines that count."""
        keys = F.transform(F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= self.min_chars), _digest)
        found = common.texts(docs).select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("doc_id"), F.explode(F.array_distinct(keys)).alias("key"))
        return found.distinct()

    def _change(self, postings: DataFrame, sign: int) -> LineIndex:
        """Adds or subtracts one for each posting; one shuffle of the touched and the old counts by key."""
        delta = postings.groupBy("key").agg((F.count("*") * sign).alias("d")).select("key", F.lit(0).cast("long").alias("n"), "d")
        old = self.refs.select("key", F.col("n_docs").alias("n"), F.lit(0).cast("long").alias("d"))
        both = old.unionByName(delta).groupBy("key").agg(F.sum("n").alias("was"), F.sum(F.col("n") + F.col("d")).alias("n_docs"))
        merged = common.materialised(both, self.spark, "line-refs")
        least = self.min_docs
        out = LineIndex(self.spark, self.min_docs, self.min_chars, self.shards)
        out.refs = merged.where("n_docs > 0").select("key", "n_docs")
        n_hot = merged.where(F.col("n_docs") >= least).count()
        while out.shards * PER_SHARD < n_hot:
            out.shards *= 2

        def rebuild(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [CuckooFilter.of(_hash64(pdf["key"]).tolist()).to_bytes()]})

        if out.shards != self.shards or self.filters.isEmpty():  # more shards than before: all filters follow from the counts
            out.filters = common.materialised(out.hot().groupBy("shard").applyInPandas(rebuild, "shard int, filter binary"), self.spark, "line-filters")
            return out
        crossed = merged.where(f"(was >= {least}) <> (n_docs >= {least})").select(self._shard(F.col("key")).alias("shard"), "key", (F.col("n_docs") >= least).alias("add"))

        def update(key, changes: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if not len(changes):
                return filters
            known = filters["filter"].tolist()
            filt = CuckooFilter.from_bytes(known[0]) if known else CuckooFilter()
            h = _hash64(changes["key"]).tolist()
            add = changes["add"].tolist()
            for x, a in zip(h, add, strict=True):
                if not a:
                    filt.delete(x)
            new = [x for x, a in zip(h, add, strict=True) if a]
            if not known:
                filt = CuckooFilter.of(new)
            else:
                for n, x in enumerate(new):
                    try:
                        filt.insert(x)
                    except OverflowError:  # full: built anew from the counts below
                        return pd.DataFrame({"shard": [key[0]], "filter": [None]})
            return pd.DataFrame({"shard": [key[0]], "filter": [filt.to_bytes()]})

        new = crossed.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(update, "shard int, filter binary")
        new = common.materialised(new, self.spark, "line-filters")
        full = new.where("filter is null").select("shard")
        again = out.hot().join(full, "shard").groupBy("shard").applyInPandas(rebuild, "shard int, filter binary")
        out.filters = new.where("filter is not null").unionByName(again)
        return out

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the lines of ``docs`` added."""
        return self._change(self.postings(docs), 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without the lines of ``docs``, which were inserted before."""
        return self._change(self.postings(docs), -1)

    def hot(self) -> DataFrame:
        """``(shard, key)`` that ``min_docs`` or more documents hold."""
        return self.refs.where(F.col("n_docs") >= self.min_docs).select(self._shard(F.col("key")).alias("shard"), "key")

    def candidates(self, postings: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """Postings that the filters let pass: all hot ones and a few in a million others.

        With more than ``filter_bytes`` of filters the postings are written by
        blocks of shards, and each block goes through its own filters.
        """
        size = self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        blocks = int(size // filter_bytes) + 1
        if blocks == 1:
            return self._passed(postings, self.filters)
        path = common.shared_dir(self.spark, "line-postings")
        postings.withColumn("block", F.pmod(self._shard(F.col("key")), F.lit(blocks))).write.partitionBy("block").parquet(path)
        out = None
        for k in range(blocks):
            own = self.spark.read.parquet(path).where(F.col("block") == k).select(*postings.columns)
            found = common.materialised(self._passed(own, self.filters.where(F.pmod("shard", F.lit(blocks)) == k)), self.spark, "line-candidates")
            out = found if out is None else out.unionByName(found)
        common.remove_dir(self.spark, path)
        return out

    def _passed(self, postings: DataFrame, filters: DataFrame) -> DataFrame:
        sent = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.collect()})  # a bounded size
        name = uuid.uuid4().hex

        @F.pandas_udf("boolean")
        def known(shard: pd.Series, key: pd.Series) -> pd.Series:
            found = common.worker_state("line-filters", name, lambda: {k: CuckooFilter.from_bytes(x) for k, x in sent.value.items()})
            h, s, out = _hash64(key), shard.to_numpy(), np.zeros(len(shard), bool)
            for k in np.unique(s).tolist():
                if k in found:
                    at = np.flatnonzero(s == k)
                    out[at] = found[k].contains(h[at])
            return pd.Series(out)

        return postings.where(known(self._shard(F.col("key")), F.col("key")))

    def dropped(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, keys)``: the lines that each document loses; documents that lose none are left out.

        A hot line stays in the largest ``doc_id`` of ``docs`` that holds it.
        """
        held = self.candidates(self.postings(docs))
        exact = held.join(self.hot().select("key"), "key", "left_semi")
        exact = common.materialised(exact, self.spark, "line-hot")
        # Written out, so that a line that very many documents hold can be split in the join: an aggregate beside it would forbid that.
        last = common.materialised(exact.groupBy("key").agg(F.max("doc_id").alias("keeper")), self.spark, "line-keepers")
        return exact.join(last, "key").where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with all columns, the new text in ``text``, and ``n_lines`` and ``n_dropped`` in a struct ``line_dedup``, which takes the place of an input column of that name."""
        drops = self.dropped(docs).select(F.col("doc_id").alias("__drop_id"), F.col("keys").alias("__drop_keys"))
        joined = docs.join(drops, F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NULL_ID)) == drops["__drop_id"], "left")
        lines = _lines(F.coalesce(F.col("text").cast("string"), F.lit("")))
        kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__drop_keys"), _digest(line_key(x))) | (F.length(line_key(x)) < self.min_chars))
        whole = F.when(F.col("__drop_keys").isNull(), lines).otherwise(kept)
        cut = joined.withColumns({"__kept": whole, "__n_lines": F.size(lines).cast("long")})
        info = F.struct(F.col("__n_lines").alias("n_lines"), (F.col("__n_lines") - F.size("__kept")).alias("n_dropped"))
        return cut.withColumns({"text": F.when(F.col("__drop_keys").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n")), "line_dedup": info}).drop("__drop_id", "__drop_keys", "__kept", "__n_lines")


def deduplicate(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """:meth:`LineIndex.apply` with an index of ``docs`` alone.

    Null and empty texts have one empty line; their text is returned as it
    is.  A text that loses all lines becomes empty.
    """
    return LineIndex(docs.sparkSession, min_docs, min_chars).insert(docs).apply(docs)
