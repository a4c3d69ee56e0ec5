"""Joins from a table in which one key may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join by the columns `on` in which a missing value equals a missing value."""
    mine = {k: f"__right_{k}" for k in on}
    renamed = right.withColumnsRenamed(mine)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in mine.items()])
    return left.join(renamed, same, how).drop(*mine.values())


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", stored: bool = False) -> DataFrame:
    """A null-safe join that adaptive execution can split, whatever share of `left` one key has.

    It splits a partition of the left side if both sides are plain scans or projections below their shuffle.
    So a right side that is not `stored` already is written first; without that, an aggregate or a distinct under
    the join would keep a hot key in one task. `right` has one row for each key, and `how` is `left` or `inner`.
    """
    return null_safe_join(left, right if stored else stage(right, "side"), on, how)
