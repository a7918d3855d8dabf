"""Near copies by SimHash and MinHash bands, verified with the exact Jaccard similarity.

Two texts are near copies if the sets of their five-word shingles have a
Jaccard similarity of 0.8 or more.  Each text has a SimHash of these
shingles; fingerprints within two bits are linked as in ``simhash``, and the
texts of a component meet in a bucket.  At similarity 0.8 about ten of the 64
bits differ, so each text also has 80 min-hashes in 20 bands of four, and
texts that share a band meet in a bucket as well.  At 0.8 a pair misses all
of these with a chance of 0.59^20 = 0.00003, above it with less.

Buckets only propose.  The smallest member of each bucket, its leader, is
paired with the members after it; pairs are verified with whole shingle sets,
and verified links make components.  A member that is no longer the smallest
of its component leaves its buckets, and so does a leader, which has met all
others.  So a large group of near copies costs links to its leader.  In
buckets that have up to ``FEW`` members after that, all are paired.  Larger
ones mostly hold texts that share a passage and no more; their members are
dealt anew by one more band of the next six, and the rounds go on.  Texts of
similarity 0.8 have eight bands in common on average, and miss two so near
each other once in about 800 pairs.  No group is paired with itself, however
large, and none is cut.

Texts that are equal but for case of ASCII letters and white space (told by
a 64-bit hash) are folded into one class before anything else.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common, simhash
from .simhash import components

SEED = 42
WORDS, BANDS, ROWS = 5, 20, 4
_RNG = np.random.default_rng(SEED)
#: 80 orders of the shingles: the upper halves of their hashes times odd numbers.
_XOR, _MUL = (_RNG.integers(0, 2**32, (BANDS * ROWS, 1), np.uint64).astype(np.uint32) | np.uint32(k) for k in (0, 1))
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _chained(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` consecutive words for each start; order matters."""
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out ^= out >> np.uint64(29)
        out *= _TURN
        out += h[k : len(h) - size + 1 + k]
    out ^= out >> np.uint64(32)
    return out * _TURN


def text_hash(h: np.ndarray) -> int:
    """Hash of all the lower-cased words of a text, given by their hashes."""
    return xxh64_intdigest(h.tobytes(), SEED)


def _distinct(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return h
    return np.unique(_chained(h, min(WORDS, len(h))))


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles; a text of fewer words is one shingle, one without words has none."""
    return _distinct(_word_hashes(text))


def similar(a: bytes, b: bytes) -> bool:
    """Whether two texts have a Jaccard similarity of 0.8 or more."""
    x, y = shingles(a), shingles(b)
    return len(np.intersect1d(x, y, assume_unique=True)) * 9 >= (len(x) + len(y)) * 4


def bands(found: np.ndarray) -> list[int]:
    """A signed hash for each band of min-hashes; none for a text without words."""
    if not len(found):
        return []
    high = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(high), 1 << 12):
        least = np.minimum(least, ((high[k : k + (1 << 12)] ^ _XOR) * _MUL).min(axis=1))
    return [xxh64_intdigest(b.tobytes(), k) - 2**63 for k, b in enumerate(least.reshape(BANDS, ROWS))]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    """What tells a row: the id with nulls after all others, and a hash of the text as it is."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _texts(docs: DataFrame) -> DataFrame:
    key, raw = _keyed(docs)
    return docs.select(key.alias("key"), raw.alias("raw"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def _signatures(docs: DataFrame) -> DataFrame:
    """``(key, raw, fp, n, sim, bands)`` of each row; ``n`` is the number of distinct shingles, ``sim`` their SimHash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, ns, sims, found = [], [], [], []
        for t in common.as_bytes(batch.column(2)):
            h = _word_hashes(t)
            s = _distinct(h)
            fps.append(text_hash(h))
            ns.append(len(s))
            sims.append(simhash.majority(s))
            found.append(bands(s))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], _signed(fps), pa.array(ns, pa.int64()), _signed(sims), pa.array(found, pa.list_(pa.int64()))], names=["key", "raw", "fp", "n", "sim", "bands"])

    return common.map_batches(_texts(docs), run, "key long, raw long, fp long, n long, sim long, bands array<long>")


def _simhash_buckets(classes: DataFrame, steps: common.Scratch) -> DataFrame:
    """``(key, raw, fp, n, gone, pos, bucket)`` of the classes with words; a bucket is a component of fingerprints within two bits."""
    worded = classes.where("n > 0")
    links = steps.written(simhash.links(worded.select(F.col("sim").alias("fp"))), "simhash-links")
    n = steps.seen(links)["rows"]
    # Written out, so that a fingerprint of very many texts can be split in the join.
    roots = steps.written(components(links, at_most=n).select(F.col("node").alias("sim"), "root"), "simhash-roots", 2 * n)
    steps.drop(links)
    return worded.join(roots, "sim", "left").select("key", "raw", "fp", "n", F.lit(0).alias("gone"), F.lit(-1).alias("pos"), F.xxhash64(F.lit("simhash"), F.coalesce("root", "sim")).alias("bucket"))


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(fp, sh)`` of the classes ``wanted (key, raw, fp)``; ``sh`` has the hashes of all shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).view(np.int64) for t in common.as_bytes(batch.column(1))], pa.list_(pa.int64()))], names=["fp", "sh"])

    rows = _texts(docs).join(wanted, ["key", "raw"]).select("fp", "text")
    return common.map_batches(rows, run, "fp long, sh array<long>").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b)`` whose shingle sets ``(fp, sh)`` have a Jaccard similarity of 0.8 or more."""
    right = pairs.join(sets.select(F.col("fp").alias("b"), F.col("sh").alias("sb")), "b")
    both = right.join(sets.select(F.col("fp").alias("a"), F.col("sh").alias("sa")), "a")
    return both.where(F.size(F.array_intersect("sa", "sb")) * 9 >= (F.size("sa") + F.size("sb")) * 4).select("a", "b")


#: Pairs that a task verifies, about.
PAIRS = 5_000
#: Members of a bucket that are all paired.
FEW = 16
#: A large bucket's members are dealt by each of so many bands that come next, in a circle; texts that share three bands share two so near.
NEXT = 6


def _crowded(members: DataFrame, steps: common.Scratch, at_most: int | None = None) -> DataFrame:
    """Members of buckets that have two or more."""
    # Written out, so that a very large bucket can be split in the join: an aggregate beside it would forbid that.
    full = steps.written(members.groupBy("bucket").count().where("count > 1").select("bucket"), "full-buckets", at_most)
    out = steps.written(members.join(full, "bucket", "left_semi"), "buckets", at_most)
    steps.drop(full)
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, one of each group of near copies: the one with the smallest doc_id.

    Null ids come after all others, equal ids are put in order by the hashes
    of their texts, and of rows that are equal in both one stays.  Texts
    without words are copies of each other.
    """
    spark = docs.sparkSession
    steps = common.Scratch(spark)
    rows = steps.written(_signatures(docs), "minhash")
    n_rows = steps.seen(rows)["rows"]
    folded = rows.groupBy("fp").agg(F.min(F.struct("key", "raw")).alias("one"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands"))
    classes = steps.written(folded.select("fp", "one.key", "one.raw", "n", "sim", "bands"), "classes", n_rows, 20_000)
    banded = classes.select("key", "raw", "fp", "n", F.lit(0).alias("gone"), F.posexplode("bands").alias("pos", "bucket"))
    exploded = steps.written(banded.unionByName(_simhash_buckets(classes, steps)), "bands")
    members = _crowded(exploded, steps, steps.seen(exploded)["rows"])
    steps.drop(exploded)
    wanted = members.select("key", "raw", "fp").distinct()
    sets = steps.written(_shingle_sets(docs, wanted), "shingles", min(n_rows, steps.seen(members)["rows"]), PAIRS)
    lost = []

    def met(members: DataFrame, n_leaders: int) -> DataFrame:
        """Pairs the first members of each bucket with those after them; gives these leaders."""
        size = steps.seen(members)["rows"]
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "fp"))
        leaders = members.withColumn("__place", place).where(F.col("__place") <= n_leaders).select("bucket", F.col("key").alias("lkey"), F.col("fp").alias("lfp"), F.col("n").alias("ln"))
        leaders = steps.written(leaders, "leaders", size)
        near = members.join(leaders, "bucket").where("struct(lkey, lfp) < struct(key, fp) and 5 * least(n, ln) >= 4 * greatest(n, ln)")
        pairs = steps.written(near.select(F.col("lfp").alias("a"), F.col("fp").alias("b")).distinct(), "pairs", size * n_leaders)
        links = steps.written(verified(pairs, sets), "links", steps.seen(pairs)["rows"], PAIRS)
        # All members are the first ones of their groups, so these links alone tell which of them aren't any more.
        found = components(links, at_most=steps.seen(links)["rows"]).join(members.select("fp", "key", "raw").distinct(), F.col("node") == F.col("fp"))
        found = steps.written(found.select("root", "key", "raw", "fp"), "groups", 2 * steps.seen(links)["rows"])
        firsts = found.groupBy("root").agg(F.min(F.struct("key", "fp")).alias("first")).select("first.fp")
        lost.append(steps.written(found.join(firsts, "fp", "left_anti").select("fp"), "lost", size))
        steps.drop(pairs, links, found)
        return leaders

    while steps.seen(members)["rows"]:
        leaders = met(members, 1)
        left = members.join(lost[-1], "fp", "left_anti").join(leaders.select("bucket", F.col("lfp").alias("fp")), ["bucket", "fp"], "left_anti")
        left = steps.written(left, "left", steps.seen(members)["rows"])
        crowd = _crowded(left, steps, steps.seen(left)["rows"])
        steps.drop(members, leaders, left)
        size = steps.seen(crowd)["rows"]
        large = steps.written(crowd.groupBy("bucket").count().where(F.col("count") > FEW).select("bucket"), "large-buckets", size)
        few = steps.written(crowd.join(large, "bucket", "left_anti"), "buckets", size)
        rest = steps.written(crowd.join(large, "bucket", "left_semi"), "buckets", size)
        if steps.seen(few)["rows"]:
            steps.drop(met(few, FEW))
        if not steps.seen(rest)["rows"]:
            break
        again = rest.join(lost[-1], "fp", "left_anti").join(classes.select("fp", "bands"), "fp")
        following = F.transform(F.sequence(F.lit(1), F.lit(NEXT)), lambda k: F.struct(k.alias("step"), F.element_at("bands", F.pmod(F.col("pos") + k, F.lit(BANDS)) + 1).alias("band")))
        dealt = again.select("key", "raw", "fp", "n", "bucket", "pos", "gone", F.explode(following).alias("x")).where(F.col("gone") + F.col("x.step") < BANDS)
        dealt = dealt.select("key", "raw", "fp", "n", F.pmod(F.col("pos") + F.col("x.step"), F.lit(BANDS)).alias("pos"), (F.col("gone") + F.col("x.step")).alias("gone"), F.xxhash64("bucket", "x.band").alias("bucket"))
        dealt = steps.written(dealt, "bands", NEXT * steps.seen(rest)["rows"])
        members = _crowded(dealt, steps, steps.seen(dealt)["rows"])
        fewer = steps.written(sets.join(members.select("fp").distinct(), "fp", "left_semi"), "shingles", steps.seen(members)["rows"], PAIRS)
        steps.drop(crowd, large, few, rest, dealt, sets)
        sets = fewer
    # All rounds in one join, as each would go through all classes.
    some = [table.select("fp") for table in lost if steps.seen(table)["rows"]]
    kept = classes.join(functools.reduce(DataFrame.unionByName, some), "fp", "left_anti") if some else classes
    keep = steps.written(kept.select("key", "raw"), "keep", n_rows)
    each = steps.written(rows.groupBy("key", "raw").count(), "rows", n_rows)
    gone = steps.written(each.join(keep, ["key", "raw"], "left_anti").select("key", "raw"), "gone", n_rows)
    twice = steps.written(each.where("count > 1").join(keep, ["key", "raw"], "left_semi").select("key", "raw"), "twice", n_rows)
    steps.keep(gone, twice)
    # What stays is most of the rows, so those that go are looked up; only rows that repeat as a whole are dealt by their keys.
    key, raw = _keyed(docs)
    gone = gone.unionByName(twice).select(F.col("key").alias("__key"), F.col("raw").alias("__raw"))
    single = docs.join(gone, (key == gone["__key"]) & (raw == gone["__raw"]), "left_anti")
    again = twice.select(F.col("key").alias("__key"), F.col("raw").alias("__raw"))
    repeated = docs.join(again, (key == again["__key"]) & (raw == again["__raw"])).dropDuplicates(["__key", "__raw"]).select(*docs.columns)
    return single.unionByName(repeated)
