"""Dense positions and running totals in a global order, without a one-task window.

A global order by a number is cut into buckets of equal width; a small
aggregate gives what lies before each bucket, and windows run inside buckets
only.  Rows that share one value share a bucket; where many rows crowd
together, give more buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scale(df: DataFrame, order: str, buckets: int) -> tuple[int, int]:
    """Where buckets begin and how wide they are, for the range of a column."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is None:
        lo = hi = 0
    return int(lo), max(1, -(-(int(hi) - int(lo) + 1) // buckets))


def _cut(df: DataFrame, order: str, buckets: int, low: int, width: int) -> DataFrame:
    """``df`` with its bucket; three times the range has buckets of its own, the rest goes to the outermost ones."""
    place = F.floor((F.col(order) - F.lit(low)) / F.lit(width)).cast("long")
    return df.withColumn("__b", F.greatest(F.lit(-buckets), F.least(F.lit(2 * buckets), place)))


def _before(totals: DataFrame, columns: list[str]) -> DataFrame:
    """Exclusive prefix sums over the buckets: as many rows as there are buckets, which is bounded."""
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__b", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__before_{c}") for c in columns])


def position(df: DataFrame, order: str, name: str, base: int = 0, buckets: int = 1024) -> DataFrame:
    """``df`` with the dense position ``base + 1 ...`` of each row in the order of a whole-number column."""
    cut = _cut(df, order, buckets, *_scale(df, order, buckets))
    before = _before(cut.groupBy("__b").agg(F.count("*").alias("n")), ["n"])
    ranked = cut.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(order)))
    return ranked.join(F.broadcast(before), "__b").withColumn(name, (F.col("__before_n") + F.col("__r") + F.lit(base)).cast("long")).select(*df.columns, name)


def totals_before(points: DataFrame, marks: DataFrame, at: str, weights: dict[str, Column], inclusive: bool = False, buckets: int = 1024) -> DataFrame:
    """For every row of ``points``, sums over the rows of ``marks`` that lie before it.

    Both have the whole-number column ``at``; ``weights`` names sums and gives
    what a mark adds.  A mark at the same place counts if ``inclusive``.
    Linear in both inputs: one sort inside buckets.
    """
    names = list(weights)
    schema = {f.name: f.dataType for f in points.schema.fields}
    side = 0 if inclusive else 2
    m = marks.select(F.col(at).cast("long").alias(at), *[w.cast("long").alias(k) for k, w in weights.items()], F.lit(side).alias("__s"), *[F.lit(None).cast(schema[c]).alias(c) for c in points.columns if c != at])
    p = points.select(F.col(at).cast("long").alias(at), *[F.lit(0).cast("long").alias(k) for k in names], F.lit(1).alias("__s"), *[c for c in points.columns if c != at])
    low, width = _scale(marks, at, buckets)
    marked = _cut(m, at, buckets, low, width)
    both = _cut(m.unionByName(p), at, buckets, low, width)
    # Every possible bucket, from the marks alone: the points are read once, however many of these are chained.
    every = marks.sparkSession.range(-buckets, 2 * buckets + 1).select(F.col("id").alias("__b"))
    sums = marked.groupBy("__b").agg(*[F.sum(k).alias(k) for k in names])
    before = _before(every.join(sums, "__b", "left").select("__b", *[F.coalesce(k, F.lit(0)).alias(k) for k in names]), names)
    w = Window.partitionBy("__b").orderBy(at, "__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.select(*both.columns, *[F.sum(k).over(w).alias(f"__run_{k}") for k in names]).where("__s = 1")
    out = run.join(F.broadcast(before), "__b")
    return out.select(*points.columns, *[(F.col(f"__before_{k}") + F.col(f"__run_{k}")).cast("long").alias(k) for k in names])
