"""Event time: watermarks that move with every record, window assigners, late rows, window reduces.

The watermark before a record is the largest time among all earlier arrivals, less the delay. A (record, window)
pair is late when the window's end is not after it. Results do not depend on how Spark partitions the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.prefix import running_max_before


@dataclass(frozen=True)
class Tumbling:
    """Windows [k*size, (k+1)*size); times before 1970 round down."""

    size: str

    def column(self, ts: str) -> Column:
        return F.window(ts, self.size)


@dataclass(frozen=True)
class Sliding:
    """Windows of `size` that start at every multiple of `slide`; slide must not exceed size."""

    size: str
    slide: str

    def __post_init__(self) -> None:
        if _micros(self.slide) > _micros(self.size):
            raise ValueError("slide must not be larger than size")

    def column(self, ts: str) -> Column:
        return F.window(ts, self.size, self.slide)


@dataclass(frozen=True)
class Custom:
    """An own assigner: a function from the time column's name to an array of structs (start, end)."""

    spans: Callable[[str], Column]


Windows = Tumbling | Sliding | Custom


@dataclass(frozen=True)
class Bounded:
    """The watermark follows the largest time, less a delay."""

    delay: str

    def mark(self, ts: str) -> Column:
        return F.col(ts)


@dataclass(frozen=True)
class Marked:
    """An own strategy: each record may set a mark, a column that is null where it sets none; the watermark is the largest
    mark so far, less a delay. Any watermark that only rises is of this form."""

    by: Column
    delay: str = "0 seconds"

    def mark(self, ts: str) -> Column:
        return self.by


Strategy = Bounded | Marked


def strategy_of(given: str | Strategy) -> Strategy:
    return Bounded(given) if isinstance(given, str) else given


_UNITS = {"millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}


def _micros(text: str) -> int:
    number, unit = text.split()
    return int(number) * _UNITS[unit.rstrip("s")]


def delay_of(delay: str) -> Column:
    return F.make_dt_interval(secs=F.lit(_micros(delay) / 1e6).cast("decimal(18,6)"))


def watermark_before(df: DataFrame, ts: str, order: list[str], strategy: str | Strategy, name: str = "wm") -> DataFrame:
    """Adds the watermark that holds when the row arrives; null before the first mark. A strategy may be a delay."""
    s = strategy_of(strategy)
    return running_max_before(df, s.mark(ts), order, name).withColumn(name, F.col(name) - delay_of(s.delay))


def watermark_after(df: DataFrame, ts: str, order: list[str], strategy: str | Strategy, name: str = "wm") -> DataFrame:
    """Adds the watermark right after the row, which counts the row itself."""
    s = strategy_of(strategy)
    top = running_max_before(df, s.mark(ts), order, name)
    return top.withColumn(name, F.greatest(F.col(name), s.mark(ts)) - delay_of(s.delay))


def assign_windows(df: DataFrame, ts: str, windows: Windows) -> DataFrame:
    """A row for each window that holds the time, with win_start and win_end. Rows with a null time have none."""
    if isinstance(windows, Custom):
        return assign_custom(df, windows.spans(ts))
    kind = df.schema[ts].dataType.simpleString()
    return (
        df.withColumn("__w", windows.column(ts))
        .withColumn("win_start", F.col("__w.start").cast(kind))
        .withColumn("win_end", F.col("__w.end").cast(kind))
        .drop("__w")
    )


def assign_custom(df: DataFrame, starts_ends: Column) -> DataFrame:
    """An own assigner: an array of structs (start, end) for each row."""
    return (
        df.withColumn("__w", F.explode(starts_ends))
        .withColumn("win_start", F.col("__w.start"))
        .withColumn("win_end", F.col("__w.end"))
        .drop("__w")
    )


def on_time(df: DataFrame, wm: str = "wm") -> DataFrame:
    """Drops late (record, window) pairs."""
    return df.filter(F.col(wm).isNull() | (F.col("win_end") > F.col(wm)))


def late(df: DataFrame, wm: str = "wm") -> DataFrame:
    """The pairs that `on_time` drops."""
    return df.filter(F.col("win_end") <= F.col(wm))


def window_reduce(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """One row for each key and window, once the window is over; partial aggregates run before the exchange."""
    return df.groupBy(*keys, "win_start", "win_end").agg(*aggregates)


def firing_order(df: DataFrame, first_order: str) -> DataFrame:
    """Adds the order in which windows fire: by end, then by the first arrival of key and window, within each end."""
    w = Window.partitionBy("win_end").orderBy(first_order)
    return df.withColumn("fire_rank", F.row_number().over(w))


def filter_after_watermark(df: DataFrame, ts: str, condition: Column) -> DataFrame:
    """A filter that stays above the watermark of a stream, so that filtered rows still move the watermark."""
    return df.filter(F.when(F.col(ts).isNotNull(), condition))
