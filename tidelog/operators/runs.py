"""Sorted runs as metadata: key ranges, overlaps, scores and size estimates.

``files (level, file_no, smallest, largest, size, n, max_seq)`` with whole
numbers for keys.  Overlaps are counted from ordered running totals: files
that overlap a closed range are all but those that end before it and those
that begin after it, so no pairs of files are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import BYTES_PER_SEEK, GRANDPARENT_FILES, L0_COMPACTION_TRIGGER, LEAST_SEEKS, LEVELS, MAX_FLUSH_LEVEL, MIB
from tidelog.operators.ranks import totals_before
from tidelog.operators.write import memory_bytes


def file_meta(log: DataFrame, file_no: Column, level: int = 0) -> DataFrame:
    """One row for each file of a log that is cut by ``file_no``."""
    return (
        log.withColumn("file_no", file_no)
        .groupBy("file_no")
        .agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.sum(memory_bytes(F.col("key").cast("string"), F.col("value"))).alias("size"), F.count("*").alias("n"), F.max("seq").alias("max_seq"))
        .select(F.lit(level).alias("level"), "file_no", "smallest", "largest", "size", "n", "max_seq")
    )


def level_totals(files: DataFrame) -> DataFrame:
    """``(level, n_files, n_bytes)`` for every level, zero where there is no file."""
    spark = files.sparkSession
    found = files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
    levels = spark.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    return levels.join(found, "level", "left").select("level", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))


def level_summary(files: DataFrame) -> DataFrame:
    """One row: ``files[ n0 n1 ... n6 ]``."""
    rows = level_totals(files).agg(F.array_sort(F.collect_list(F.struct("level", "n_files"))).alias("x"))
    return rows.select(F.concat(F.lit("files[ "), F.array_join(F.transform("x", lambda s: s["n_files"].cast("string")), " "), F.lit(" ]")).alias("summary"))


def key_range(files: DataFrame) -> DataFrame:
    return files.agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


def find_file(files: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """``probes`` with ``idx``, the first file of a level whose largest key is at or above the key (the number of files if none is)."""
    at = probes.withColumnRenamed(key, "__at")
    return totals_before(at, files.select(F.col("largest").alias("__at")), "__at", {"idx": F.lit(1)}).withColumnRenamed("__at", key)


def overlap(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """``ranges (lo, hi, ...)`` with ``n_overlap`` files and ``overlap_bytes`` of a level; null bounds are open."""
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.coalesce(F.min("smallest"), F.lit(0)).alias("lo"), F.coalesce(F.max("largest"), F.lit(0)).alias("hi")).first()
    size = F.col("size")
    low = ranges.withColumn("__at", F.coalesce("lo", F.lit(total["lo"])).cast("long"))
    low = totals_before(low, files.select(F.col("largest").alias("__at"), size), "__at", {"__n1": F.lit(1), "__b1": size}).drop("__at")
    high = low.withColumn("__at", F.coalesce("hi", F.lit(total["hi"])).cast("long"))
    both = totals_before(high, files.select(F.col("smallest").alias("__at"), size), "__at", {"__n2": F.lit(1), "__b2": size}, inclusive=True)
    return both.select(*ranges.columns, F.greatest(F.lit(0).cast("long"), F.col("__n2") - F.col("__n1")).alias("n_overlap"), F.greatest(F.lit(0).cast("long"), F.col("__b2") - F.col("__b1")).alias("overlap_bytes"))


def connected(files: DataFrame) -> DataFrame:
    """``files`` with ``part``: files that overlap, directly or over others, share one; gaps and islands over a level's file list."""
    w = Window.partitionBy("level").orderBy("smallest", "largest", "file_no")
    reach = F.max("largest").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = files.withColumn("__new", (reach.isNull() | (F.col("smallest") > reach)).cast("long"))
    return starts.withColumn("part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def scores(files: DataFrame) -> DataFrame:
    """``(level, score)`` of the levels that can be compacted: files against the trigger for level 0, bytes against the budget for others."""
    budget = F.lit(float(10 * MIB)) * F.pow(F.lit(10.0), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("n_files") / F.lit(float(L0_COMPACTION_TRIGGER))).otherwise(F.col("n_bytes") / budget)
    return level_totals(files).where(F.col("level") < LEVELS - 1).select("level", score.alias("score"))


def next_compaction(files: DataFrame) -> DataFrame:
    """``(level, score, needed)``: the level of the highest score, the first one of equals."""
    best = scores(files).agg(F.max(F.struct("score", -F.col("level"))).alias("m"))
    return best.select((-F.col("m.col2")).alias("level"), F.col("m.score").alias("score"), (F.col("m.score") >= 1).alias("needed"))


def flush_level(ranges: DataFrame, files: DataFrame, file_size: int) -> DataFrame:
    """``ranges (lo, hi, ...)`` of new runs with the ``level`` to put each in.

    Level 0 if it overlaps a file there; else one deeper while nothing
    overlaps in the next level and little does in the one after.
    """
    at = ranges
    for level in range(MAX_FLUSH_LEVEL + 2):
        found = overlap(at, files.where(F.col("level") == level))
        at = found.withColumnRenamed("n_overlap", f"__n{level}_").withColumnRenamed("overlap_bytes", f"__b{level}_")
    limit = GRANDPARENT_FILES * file_size
    out: Column = F.lit(MAX_FLUSH_LEVEL)
    for level in range(MAX_FLUSH_LEVEL - 1, -1, -1):
        blocked = (F.col(f"__n{level + 1}_") > 0) | (F.col(f"__b{level + 2}_") > limit)
        out = F.when(blocked, level).otherwise(out)
    return at.select(*ranges.columns, F.when(F.col("__n0_") > 0, 0).otherwise(out).alias("level"))


def next_level_overlap(files: DataFrame) -> DataFrame:
    """``(level, file_no, overlap_bytes)``: bytes of the next level that each file of levels 1 to 5 overlaps."""
    out = None
    for level in range(1, LEVELS - 1):
        part = overlap(files.where(F.col("level") == level).select("level", "file_no", F.col("smallest").alias("lo"), F.col("largest").alias("hi")), files.where(F.col("level") == level + 1))
        part = part.select("level", "file_no", "overlap_bytes")
        out = part if out is None else out.unionByName(part)
    return out


def allowed_seeks(files: DataFrame) -> DataFrame:
    return files.select("level", "file_no", F.greatest(F.lit(LEAST_SEEKS), F.floor(F.col("size") / BYTES_PER_SEEK)).cast("long").alias("allowed_seeks"))


def files_probed(probes: DataFrame, files: DataFrame) -> DataFrame:
    """``probes (key, ...)`` with how many files' ranges cover the key."""
    at = probes.withColumnRenamed("key", "__at")
    begun = totals_before(at, files.select(F.col("smallest").alias("__at")), "__at", {"__begun": F.lit(1)}, inclusive=True)
    ended = totals_before(begun, files.select(F.col("largest").alias("__at")), "__at", {"__ended": F.lit(1)})
    return ended.withColumn("n_probed", F.col("__begun") - F.col("__ended")).withColumnRenamed("__at", "key").select(*probes.columns, "n_probed")


def approximate_size(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """``ranges (lo, hi, ...)`` with estimated bytes of ``[lo, hi)``.

    A bound's offset is the bytes of all files that end before it and of the
    file that straddles it the share of its key range before it.
    """
    size = F.col("size")

    def offset(df: DataFrame, bound: str, name: str) -> DataFrame:
        at = df.withColumn("__at", F.col(bound).cast("long"))
        whole = totals_before(at, files.select(F.col("largest").alias("__at"), size), "__at", {"__whole": size})
        # Straddling files: begun before, not ended before. The share is linear in the bound, so sums of slopes do.
        slope = F.floor(size * F.lit(1024) / (F.col("largest") - F.col("smallest") + 1)).cast("long")
        begun = totals_before(whole, files.select(F.col("smallest").alias("__at"), "smallest", "largest", size), "__at", {"__s1": slope, "__p1": slope * F.col("smallest")})
        ended = totals_before(begun, files.select(F.col("largest").alias("__at"), "smallest", "largest", size), "__at", {"__s2": slope, "__p2": slope * F.col("smallest")})
        part = F.floor(((F.col("__s1") - F.col("__s2")) * F.col("__at") - (F.col("__p1") - F.col("__p2"))) / F.lit(1024))
        return ended.withColumn(name, (F.col("__whole") + part).cast("long")).select(*df.columns, name)

    both = offset(offset(ranges, "lo", "__o1"), "hi", "__o2")
    return both.select(*ranges.columns, F.greatest(F.lit(0).cast("long"), F.col("__o2") - F.col("__o1")).alias("approx_bytes"))


def pick_inputs(files: DataFrame, level: int, after: int | None = None) -> DataFrame:
    """The files that the next compaction of a level begins with.

    The first file that reaches beyond ``after``, the key where the last
    compaction stopped; where none does, the first of the level.  Files of
    level 0 overlap, so all that hang together with it come along.
    """
    own = files.where(F.col("level") == level)
    passed = F.lit(False) if after is None else F.col("largest") <= after
    order = F.struct(passed.alias("passed"), F.col("file_no") if level == 0 else F.col("smallest"), F.col("file_no").alias("no"))
    first = own.agg(F.min(order).alias("m")).select(F.col("m.no").alias("file_no")).where("file_no is not null")
    if level:
        return own.join(first, "file_no", "left_semi")
    parts = connected(own)
    return parts.join(parts.join(first, "file_no", "left_semi").select("part"), "part", "left_semi").drop("part")


def _within(files: DataFrame, level: int, lo, hi) -> DataFrame:
    """Files of a level that overlap a closed range; of level 0 all that hang together with those."""
    own = files.where(F.col("level") == level)
    hit = (F.col("smallest") <= hi) & (F.col("largest") >= lo)
    if level:
        return own.where(hit)
    parts = connected(own)
    return parts.join(parts.where(hit).select("part").distinct(), "part", "left_semi").drop("part")


def expand_inputs(files: DataFrame, picked: DataFrame, level: int, limit: int) -> DataFrame:
    """``(side, level, file_no)``: all files of a compaction that begins with ``picked``.

    Side 0 are files of the level, side 1 those of the next one that they
    overlap, side 2 those of the level after (the grandparents).  Side 0 takes
    in all files in the range of both sides if that brings no more files of
    the next level and both stay under ``limit`` bytes.  A compaction's files
    are metadata: only their ranges, numbers and sums reach the driver.
    """

    def totals(df: DataFrame):
        return df.agg(F.min("smallest"), F.max("largest"), F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    lo, hi, n0, _ = totals(picked)
    if lo is None:
        return files.where("false").select(F.lit(0).alias("side"), "level", "file_no")
    below = _within(files, level + 1, lo, hi)
    lo1, hi1, n1, size1 = totals(below)
    if n1:
        wider = _within(files, level, min(lo, lo1), max(hi, hi1))
        lo2, hi2, n2, size2 = totals(wider)
        if n2 > n0 and size1 + size2 < limit:
            more = _within(files, level + 1, lo2, hi2)
            if totals(more)[2] == n1:
                picked, below, lo, hi = wider, more, lo2, hi2
                lo1, hi1, *_ = totals(below)
        lo, hi = min(lo, lo1), max(hi, hi1)
    sides = [picked, below, _within(files, level + 2, lo, hi)]
    out = [side.select(F.lit(k).alias("side"), "level", "file_no") for k, side in enumerate(sides)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def stop_before(keys: DataFrame, grandparents: DataFrame, limit: int) -> DataFrame:
    """``keys (key)`` with ``out_no``: a compaction's output is cut before the key at which the grandparents passed since the last cut exceed ``limit`` bytes.

    What is passed before a key is a running total; it changes only at a
    grandparent's end, so the cuts follow from one row for each grandparent of
    the compaction, whatever the number of keys.
    """
    ends = grandparents.select(F.col("largest").alias("key"), "size")
    passed = totals_before(keys.select("key").distinct(), ends, "key", {"passed": F.col("size")})
    steps = passed.groupBy("passed").agg(F.min("key").alias("key")).withColumn("__all", F.lit(0))

    def cuts(pdf):
        pdf = pdf.sort_values("key")
        base, out = None, []
        for total, key in zip(pdf["passed"], pdf["key"], strict=True):
            if base is None:
                base = total
            elif total - base > limit:
                base = total
                out.append(key)
        return pdf.iloc[: len(out)].assign(key=out)[["key"]]

    cut = steps.groupBy("__all").applyInPandas(cuts, "key long")
    return totals_before(keys, cut, "key", {"out_no": F.lit(1)}, inclusive=True)


def output_files(log: DataFrame, file_bytes: int, chunks: int = 64) -> DataFrame:
    """``log`` with ``out_no``: compaction output cut at about ``file_bytes`` in key order, never inside a key.

    A key's place is the bytes of the keys before it, from running totals in
    buckets of the key order.
    """
    sizes = log.groupBy("key").agg(F.sum(memory_bytes(F.col("key").cast("string"), F.col("value"))).alias("b"))
    place = totals_before(sizes.select("key"), sizes, "key", {"before": F.col("b")}, buckets=chunks)
    return log.join(place.select("key", F.floor(F.col("before") / F.lit(file_bytes)).cast("long").alias("out_no")), "key")
