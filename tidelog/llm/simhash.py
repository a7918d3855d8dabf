"""SimHash near-duplicate components by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at Hamming distance 2 or less have a common
neighbour at distance 1 or less from both.  So each distinct fingerprint
emits itself and its 64 one-bit variants, the variants are the shuffle key,
and fingerprints that meet at a variant are linked.  At most 65 fingerprints
can meet at one variant, whatever the data, so a group is bounded by
construction.  Instead of all pairs of a group, each member is linked to the
smallest one; as any two members are within two bits, this keeps every
component.  Links are verified with a bit count, made distinct, and the
components follow by alternating large and small stars.

Copies share a fingerprint and are folded into one class (with a map-side
partial aggregate) before anything else, so groups of copies, however large,
cost one row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

SEED = 42


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none: 0."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        part = h[k : k + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, n: int = 3) -> int:
    """Unsigned SimHash of a text's word ``n``-grams (repeats count; none: 0)."""
    words = text.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= n:
        return xxh64_intdigest(norm, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-n] + 1).tolist()]
    return majority(np.array([xxh64_intdigest(norm[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64))


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """``(doc_id, fp long)``; the fingerprint's bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, n) for t in common.as_bytes(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return common.map_batches(common.texts(docs), run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame) -> DataFrame:
    """Verified links ``(a, b)``, a < b, that connect all distinct ``fp`` within two bits."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in [0, *(1 << i for i in range(64))]])
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = fps.select("fp").distinct().repartition(parts, "fp")  # dealt anew, as each row becomes 65
    variants = distinct.select("fp", F.explode(masks).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("v"), "fp")
    group = Window.partitionBy("v").orderBy("fp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = variants.select("fp", F.first("fp").over(group).alias("lo")).where("lo <> fp")
    return met.where(F.bit_count(F.col("lo").bitwiseXOR(F.col("fp"))) <= 2).select(F.col("lo").alias("a"), F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60, at_most: int | None = None) -> DataFrame:
    """``(node, root)`` of every node of ``(a, b)``; the root is the component's smallest node.

    Alternating large-star and small-star steps; each is written to the
    shared folder, which cuts the lineage and survives lost executors.  The
    smallest neighbours are written out as well before they are joined, so
    that adaptive execution can split a hub with very many neighbours; an
    aggregate beside the join would forbid that.  ``at_most`` bounds the
    number of edges, if known.
    """
    steps = common.Scratch(edges.sparkSession)
    big = "decimal(38,0)"

    def written(e: DataFrame, at_most: int | None) -> tuple[DataFrame, dict]:
        """Distinct edges, written, and what tells whether they changed."""
        out = steps.written(e.where("a <> b").distinct(), "edges", at_most, x=F.sum(F.xxhash64("a", "b").cast(big)), y=F.sum(F.xxhash64("b", "a").cast(big)))
        return out, steps.seen(out)

    now, seen = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), at_most)
    for _ in range(max_rounds):
        n = seen["rows"]
        if not n:
            break
        wide = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = steps.written(wide.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", 2 * n)
        large, _ = written(wide.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), n)
        steps.keep(large)
        down = steps.written(large.groupBy("a").agg(F.min("b").alias("m")), "least", n)
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        then, (now, seen) = seen, written(small, 2 * n)
        steps.keep(now)
        if seen == then:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, n: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    ``fingerprint`` has 16 lower-case hex digits; ``component_id`` is the
    smallest doc_id reachable over fingerprints within two bits, itself
    included.  Texts without words (null or empty) have fingerprint zero and
    are linked like any other.  Repeated rows give repeated rows.  Null ids
    never name a component unless all ids of the component are null.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    fps = common.materialised(fingerprints(docs, n), spark, "simhash")
    roots = components(links(fps))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
