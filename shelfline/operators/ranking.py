"""Picking and numbering rows inside groups when one group may hold a third of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import null_safe_join


def first_n_per(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first `n` rows of each group.

    Written as a rank filter: Spark keeps only `n` rows per group in each task before the shuffle,
    so a hot group reaches its final task as `n` rows per upstream task.
    """
    rn = "__rn"
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n).drop(rn)


def number_within(
    df: DataFrame, keys: list[str], bucket: list[str], order: list[Column | str], out: str
) -> DataFrame:
    """Zero-based position of every row within its group, without one task seeing a whole group.

    `bucket` cuts a group into consecutive runs of bounded size (file splits, or ranges of ids) and
    sorts like the group does. Rows are counted per bucket, the counts are summed up along the
    group, and rows are numbered inside their bucket only. A missing key or bucket is one like any other.
    """
    spot = keys + bucket
    sizes = df.groupBy(*spot).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*spot, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = df.withColumn("__rn", F.row_number().over(W.partitionBy(*spot).orderBy(*order)))
    placed = null_safe_join(inside, starts, spot, "inner")
    return placed.withColumn(out, F.col("__start") + F.col("__rn") - 1).drop("__start", "__rn")


def id_bucket(id_col: str, bits: int = 20) -> Column:
    """Range of `2^bits` ids for `number_within`: an id occurs once per group, so a range bounds its rows."""
    return F.shiftright(F.col(id_col), bits)
