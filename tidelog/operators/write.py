"""Batches of writes: sequence numbers, sizes, grouping and admission."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import L0_SLOWDOWN, L0_STOP, MIB, VALUE
from tidelog.operators.ranks import position


def sequence(batch: DataFrame, last: int, order: str = "ord") -> DataFrame:
    """``batch`` with ``seq = last + 1 ... last + n`` in its order; later operations get larger numbers."""
    return position(batch, order, "seq", last)


def octets(c: Column) -> Column:
    return F.coalesce(F.octet_length(c.cast("binary")), F.lit(0)).cast("long")


def memory_bytes(key: Column, value: Column) -> Column:
    """What a change takes in memory: 5 + key + 8 + value bytes."""
    return octets(key) + octets(value) + F.lit(13)


def batch_bytes(key: Column, type_: Column, value: Column) -> Column:
    """What an operation takes in a batch record: 5 + key + value for a put, 3 + key for a deletion; a batch has 12 more."""
    return F.when(type_ == VALUE, octets(key) + octets(value) + 5).otherwise(octets(key) + 3)


BATCH_HEADER = 12


def group_limit(first: int) -> int:
    """Bytes that a commit group may have, given its first batch: 1 MiB, or 128 KiB more than a small first batch."""
    return first + (128 << 10) if first <= 128 << 10 else MIB


def commit_groups(writers: DataFrame) -> DataFrame:
    """``writers (queue, ord, bytes, sync)`` with the number of the group that commits each.

    A group takes writers in order while it stays within its limit and takes
    no synced write into a group that began without sync.  The rule is a fold
    over a queue, so each queue is one group of rows; queues are independent.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        group, size, limit, synced, out = 0, 0, -1, False, []
        for n, s in zip(pdf["bytes"].tolist(), pdf["sync"].tolist(), strict=True):
            if group and size + n <= limit and not (s and not synced):
                size += n
            else:
                group, size, limit, synced = group + 1, n, group_limit(n), s
            out.append(group)
        return pdf.assign(group_no=out)[["queue", "ord", "group_no"]]

    return writers.groupBy("queue").applyInPandas(fold, "queue long, ord long, group_no long")


def admission(failed: Column, l0_files: Column, delayed: Column, memory: Column, limit: Column, flushing: Column) -> Column:
    """What a writer does next, as the first rule that holds."""
    return (
        F.when(failed, "fail")
        .when(~delayed & (l0_files >= L0_SLOWDOWN), "delay")
        .when(memory <= limit, "write")
        .when(flushing, "wait for flush")
        .when(l0_files >= L0_STOP, "wait for compaction")
        .otherwise("switch buffer")
    )
