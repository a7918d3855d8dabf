"""Metadata as a fold of edits, and what follows for files on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import Corruption


def fold(edits: DataFrame) -> DataFrame:
    """Live ``(level, file_no)`` of ``edits (edit_no, op, level, file_no)``: those whose last edit adds them."""
    last = edits.groupBy("level", "file_no").agg(F.max_by("op", "edit_no").alias("op"))
    return last.where("op = 'add'").select("level", "file_no")


def live(*sets: DataFrame) -> DataFrame:
    """Distinct file numbers of several versions and of outputs in the making."""
    out = sets[0].select("file_no")
    for s in sets[1:]:
        out = out.unionByName(s.select("file_no"))
    return out.distinct()


def obsolete(found: DataFrame, live_files: DataFrame, log_no: int, prev_log_no: int, manifest_no: int) -> DataFrame:
    """Rows of ``found (name, number, kind)`` that no rule keeps.

    Logs stay from the current one on and the one before a switch, manifests
    from the current one on, tables and temporary files while live, all other
    kinds always.
    """
    alive = live_files.select(F.col("file_no").alias("number"), F.lit(True).alias("alive"))
    keep = (
        F.when(F.col("kind") == "log", (F.col("number") >= log_no) | (F.col("number") == prev_log_no))
        .when(F.col("kind") == "manifest", F.col("number") >= manifest_no)
        .when(F.col("kind").isin("table", "temp"), F.coalesce("alive", F.lit(False)))
        .otherwise(True)
    )
    return found.join(alive, "number", "left").where(~keep).select("name", "number", "kind")


def missing(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.select("file_no").distinct().join(found.select("file_no").distinct(), "file_no", "left_anti")


def require_present(expected: DataFrame, found: DataFrame) -> None:
    gone = [r["file_no"] for r in missing(expected, found).orderBy("file_no").limit(20).collect()]
    if gone:
        raise Corruption(f"missing files: {gone}")


def parse_name(name: Column) -> Column:
    """``(number, kind)`` of a file name, null for names of no kind.

    ``NNN.log``, ``NNN.ldb`` and ``NNN.sst`` (tables), ``NNN.dbtmp``,
    ``MANIFEST-NNN``, ``CURRENT``, ``LOCK``, ``LOG`` and ``LOG.old``; numbers
    fit in 63 bits.
    """
    digits = F.coalesce(F.nullif(F.regexp_extract(name, r"^([0-9]+)\.(log|ldb|sst|dbtmp)$", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"^MANIFEST-([0-9]+)$", 1), F.lit("")))
    number = digits.try_cast("long")
    suffix = F.regexp_extract(name, r"^[0-9]+\.(log|ldb|sst|dbtmp)$", 1)
    kind = (
        F.when(number.isNotNull() & (suffix == "log"), "log")
        .when(number.isNotNull() & suffix.isin("ldb", "sst"), "table")
        .when(number.isNotNull() & (suffix == "dbtmp"), "temp")
        .when(number.isNotNull(), "manifest")
        .when(name == "CURRENT", "current")
        .when(name == "LOCK", "lock")
        .when(name.isin("LOG", "LOG.old"), "info")
    )
    return F.struct(F.when(kind.isin("current", "lock", "info"), F.lit(0).cast("long")).otherwise(number).alias("number"), kind.alias("kind"))
