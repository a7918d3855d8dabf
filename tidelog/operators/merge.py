"""Ordered union of sorted runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(*runs: DataFrame, ordered: bool = True) -> DataFrame:
    """All changes of all runs in internal order (key up, seq down); nothing is folded, a key in k runs comes k times."""
    union = reduce(lambda a, b: a.unionByName(b), runs)
    return union.orderBy(F.asc("key"), F.desc("seq"), F.desc("type")) if ordered else union
