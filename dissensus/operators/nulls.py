"""Joins on group keys that may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where null equals null; the columns of ``left`` come first.

    The keys of ``right`` are dropped. Without keys both sides are one group.
    """
    if not keys:
        return left.join(right, F.lit(True), how)
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__right_{k}`")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])
