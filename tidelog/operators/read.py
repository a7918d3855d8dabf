"""Reads of a change log ``(key, seq, type, value)`` as of a snapshot.

Everything here is DataFrame to DataFrame.  Version resolution is an aggregate
with map-side partials (``max_by`` over ``seq``), so a hot key costs one row a
map task in the shuffle; no window needs all versions of a key together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import VALUE


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Changes at or before a snapshot; None: all."""
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def last_sequence(log: DataFrame) -> int:
    """The largest sequence number, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"]


def key_between(low=None, high=None, key: str = "key") -> Column:
    """Closed key range; None leaves a side open."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(key) >= F.lit(low))
    if high is not None:
        out = out & (F.col(key) <= F.lit(high))
    return out


def newest(log: DataFrame) -> DataFrame:
    """The newest change of every key, ``(key, seq, type, value)``, deletions included."""
    return log.groupBy("key").agg(F.max_by(F.struct("seq", "type", "value"), "seq").alias("m")).select("key", "m.seq", "m.type", "m.value")


def resolve(log: DataFrame, snapshot: int | None = None, include_tombstones: bool = False) -> DataFrame:
    """``(key, seq, value)`` as of a snapshot: one row a key, the newest visible version.

    Deleted keys are left out, or kept with a null value.
    """
    rows = newest(visible(log, snapshot))
    if include_tombstones:
        return rows.select("key", "seq", F.when(F.col("type") == VALUE, F.col("value")).alias("value"))
    return rows.where(F.col("type") == VALUE).select("key", "seq", "value")


def scan(log: DataFrame, snapshot: int | None = None, low=None, high=None, reverse: bool = False, include_tombstones: bool = False) -> DataFrame:
    """:func:`resolve` over a closed key range in key order; the range reaches the file scan."""
    rows = resolve(log.where(key_between(low, high)), snapshot, include_tombstones)
    return rows.orderBy(F.desc("key") if reverse else F.asc("key"))


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The value of a key as of a snapshot, no row if there is none or it is deleted."""
    found = visible(log.where(F.col("key") == F.lit(key)), snapshot).orderBy(F.desc("seq")).limit(1)
    return found.where(F.col("type") == VALUE).select("key", "seq", "value")


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``(key, value)`` for every row of ``keys``, null where there is no value."""
    wanted = keys.select("key").distinct()
    found = resolve(log.join(wanted, "key", "left_semi"), snapshot)
    return keys.select("key").join(found.select("key", "value"), "key", "left")


def history(log: DataFrame, low=None, high=None) -> DataFrame:
    """Counts and ends of every key's versions."""
    return log.where(key_between(low, high)).groupBy("key").agg(
        F.count("*").alias("n_versions"),
        F.sum((F.col("type") != VALUE).cast("long")).alias("n_deletions"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def as_of(log: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes (key, at, ...)`` with ``found_seq`` and ``value`` of the newest version at or before ``at``.

    Probes and versions are merged by one sort a key, linear in both, instead
    of a join that pairs each probe with all versions of its key.
    """
    extra = [c for c in probes.columns if c not in ("key", "at")]
    schema = {f.name: f.dataType for f in probes.schema.fields}
    versions = log.select("key", F.col("seq").alias("at"), F.struct("seq", "type", "value").alias("v"), F.lit(0).alias("side"), *[F.lit(None).cast(schema[c]).alias(c) for c in extra])
    asked = probes.select("key", F.col("at").cast("long").alias("at"), F.lit(None).cast(versions.schema["v"].dataType).alias("v"), F.lit(1).alias("side"), *extra)
    w = Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = versions.unionByName(asked).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1")
    live = F.col("v.type") == VALUE
    return merged.select("key", "at", *extra, F.when(live, F.col("v.seq")).alias("found_seq"), F.when(live, F.col("v.value")).alias("value"))


def diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """``(key, change, old_value, new_value)`` between two snapshots, unchanged keys left out; one aggregate for both."""
    state = F.struct("type", "value")
    both = log.where(F.col("seq") <= max(old, new)).groupBy("key").agg(
        F.max_by(F.when(F.col("seq") <= old, state), F.when(F.col("seq") <= old, F.col("seq"))).alias("a"),
        F.max_by(F.when(F.col("seq") <= new, state), F.when(F.col("seq") <= new, F.col("seq"))).alias("b"),
        F.max(F.when(F.col("seq") <= old, F.col("seq"))).alias("sa"),
        F.max(F.when(F.col("seq") <= new, F.col("seq"))).alias("sb"),
    )
    has_a, has_b = (F.coalesce(F.col(f"{x}.type") == VALUE, F.lit(False)) for x in "ab")
    change = F.when(~has_a & has_b, "added").when(has_a & ~has_b, "removed").when(has_a & has_b & (F.col("sa") != F.col("sb")), "changed")
    return both.select("key", change.alias("change"), F.when(has_a, F.col("a.value")).alias("old_value"), F.when(has_b, F.col("b.value")).alias("new_value")).where("change is not null")
