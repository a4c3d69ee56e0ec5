"""Running totals over a table too large for one window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import stage


def with_running_totals(
    df: DataFrame, values: dict[str, str], order: list, group: list[str], label: str
) -> DataFrame:
    """`df` with a column for each of `values` (new name: column): its sum over rows of the same `group` that come before.

    Rows are dealt by ranges of group and order and written once; sums run inside each range, and the sums of
    the ranges, one row for each range and group, are added up apart. A group of any size is spread over many
    ranges. `group` and `order` together must tell rows apart, or equal rows take places in any order.
    """
    dealt = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    dealt = stage(dealt, label)
    within = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = {f"_inner_{k}": F.sum(c).over(within) - F.col(c) for k, c in values.items()}
    totals = dealt.groupBy("_range", *group).agg(*(F.sum(c).alias(f"_n_{k}") for k, c in values.items()))
    over = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    keys = ["_range", *group]
    totals = totals.select(*keys, *((F.sum(f"_n_{k}").over(over) - F.col(f"_n_{k}")).alias(f"_base_{k}") for k in values))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = dealt.withColumns(inner).alias("l").join(totals.alias("r"), on)
    kept = [F.col(f"l.{c}") for c in df.columns]
    return joined.select(*kept, *((F.col(f"r._base_{k}") + F.col(f"l._inner_{k}")).alias(k) for k in values))


def with_running_total(df: DataFrame, value: str, order: list[str], group: list[str], name: str, label: str) -> DataFrame:
    """`with_running_totals` for one column."""
    return with_running_totals(df, {name: value}, order, group, label)
