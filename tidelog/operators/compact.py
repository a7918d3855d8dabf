"""Compaction of a change log at the oldest live snapshot.

Rule A drops a change if a newer one of its key is at or below the snapshot:
what stays are all changes above it and the newest one at or below it.  The
first part needs no shuffle, the second is an aggregate with map-side
partials.  Rule B drops a deletion at or below the snapshot unless a file of
a deeper level covers its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.model import DELETION
from tidelog.operators.ranks import totals_before
from tidelog.operators.read import newest


def oldest_snapshot(snapshots: DataFrame, last: int) -> int:
    """The smallest live snapshot, or the last sequence number if there is none."""
    return snapshots.agg(F.coalesce(F.min("seq"), F.lit(last)).cast("long").alias("s")).first()["s"]


def shadowed_dropped(log: DataFrame, snapshot: int) -> DataFrame:
    """Rule A."""
    columns = ["key", "seq", "type", "value"]
    return log.select(columns).where(F.col("seq") > snapshot).unionByName(newest(log.where(F.col("seq") <= snapshot)).select(columns))


def covered(rows: DataFrame, files: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with ``covered``: whether some file's closed range ``[smallest, largest]`` has the key.

    Counts files that begin at or before the key and files that end before it;
    neither joins rows with files.  Keys are whole numbers.
    """
    at = rows.withColumnRenamed(key, "__at")
    begun = totals_before(at, files.select(F.col("smallest").alias("__at")), "__at", {"__begun": F.lit(1)}, inclusive=True)
    ended = totals_before(begun, files.select(F.col("largest").alias("__at")), "__at", {"__ended": F.lit(1)})
    return ended.withColumn("covered", F.col("__begun") > F.col("__ended")).withColumnRenamed("__at", key).select(*rows.columns, "covered")


def compact(log: DataFrame, snapshot: int, deeper: DataFrame | None = None) -> DataFrame:
    """Rules A and B; ``deeper`` has the files ``(smallest, largest)`` of deeper levels, None: there are none."""
    kept = shadowed_dropped(log, snapshot)
    dead = (F.col("type") == DELETION) & (F.col("seq") <= snapshot)
    if deeper is None:
        return kept.where(~dead)
    hidden = covered(kept.where(dead), deeper).where("covered").drop("covered")
    return kept.where(~dead).unionByName(hidden)
