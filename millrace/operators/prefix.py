"""Prefix aggregates over one global order without a single-task sort.

A window with no partition key would pull all rows into one task. Rows are instead put into ranges of the order
column, and ranges into groups of ranges. Each is folded on its own, and what comes before it is carried to it through a
small table, so the one window without a key sees a row for each WIDTH * GROUP order values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values per range, and ranges per group.
WIDTH, GROUP = 65_536, 4_096


def _carry(ranges: DataFrame, fold: Callable[[str], Column], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """(__block, __carry): the fold of `__top` over all earlier ranges."""
    grouped = ranges.withColumn("__group", F.floor(F.col("__block") / GROUP).cast("bigint"))
    tops = grouped.groupBy("__group").agg(fold("__top").alias("__t"))
    earlier = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select("__group", fold("__t").over(earlier).alias("__before"))
    inside = Window.partitionBy("__group").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    own = grouped.select("__group", "__block", fold("__top").over(inside).alias("__inside"))
    return own.join(before, "__group").select("__block", combine(F.col("__inside"), F.col("__before")).alias("__carry"))


def running_max_before(df: DataFrame, value: Column, order: list[str], name: str, width: int = WIDTH) -> DataFrame:
    """Adds the maximum of `value` over all rows strictly before this one in `order` (null for the first).

    `order[0]` must be an integer column; further columns break its ties.
    """
    tagged = df.withColumn("__block", F.floor(F.col(order[0]) / width).cast("bigint")).withColumn("__v", value)
    tops = tagged.groupBy("__block").agg(F.max("__v").alias("__top"))
    inside = Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.join(_carry(tops, F.max, F.greatest), "__block")
        .withColumn(name, F.greatest(F.max("__v").over(inside), F.col("__carry")))
        .drop("__block", "__v", "__carry")
    )


def ordinal(df: DataFrame, order: str, name: str, width: int = WIDTH) -> DataFrame:
    """Adds the 0-based position of each row in the order of an integer column."""
    tagged = df.withColumn("__block", F.floor(F.col(order) / width).cast("bigint"))
    counts = tagged.groupBy("__block").agg(F.count(F.lit(1)).alias("__top"))
    inside = Window.partitionBy("__block").orderBy(order)
    added = _carry(counts, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return (
        tagged.join(added, "__block")
        .withColumn(name, F.row_number().over(inside).cast("bigint") - 1 + F.col("__carry"))
        .drop("__block", "__carry")
    )
