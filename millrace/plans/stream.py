"""A fluent stream over a DataFrame, batch or streaming: every verb adds to the plan, nothing runs before a sink does."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from millrace.operators import eventtime, keyed, stateless
from millrace.operators.eventtime import Bounded, Strategy, Windows, strategy_of
from millrace.sources.collection import ORDER, collection
from millrace.sources.custom import SourceFunction, add_source
from millrace.sources.tables import read_table, stream_table
from millrace.streaming import processors, runner

#: The named folds as functions of two values, for streams.
FOLDS: dict[str, Callable[[Any, Any], Any]] = {"sum": lambda a, b: a + b, "min": min, "max": max}


@dataclass(frozen=True)
class Stream:
    """A DataFrame with the name of its arrival-order column and, once assigned, its event time."""

    df: DataFrame
    order: str
    ts: str | None = None
    strategy: Strategy | None = None
    flush: runner.Flush | None = None

    def _with(self, df: DataFrame) -> Stream:
        return replace(self, df=df)

    def map(self, **columns: Column) -> Stream:
        """Replaces or adds columns; order and time columns stay."""
        return self._with(self.df.withColumns(columns))

    def map_rows(self, fn: Callable[[dict], tuple], schema: str) -> Stream:
        """An opaque function of one record; its schema must have the order column, and the time column if there is one."""
        return self._with(stateless.map_rows(self.df, fn, schema))

    def flat_map(self, items: Column, name: str) -> Stream:
        """A row for each array element; elements keep the order and time of their row."""
        return self._with(self.df.withColumn(name, F.explode(items)))

    def flat_map_rows(self, fn: Callable[[dict], Iterable[tuple]], schema: str) -> Stream:
        """An opaque function that yields any number of tuples for a record."""
        return self._with(stateless.flat_map_rows(self.df, fn, schema))

    def filter(self, condition: Column) -> Stream:
        """Keeps rows; behind an assigned watermark, dropped rows still move the watermark."""
        if self.ts:
            return self._with(eventtime.filter_after_watermark(self._watermarked(), self.ts, condition))
        return self._with(self.df.filter(condition))

    def assign_timestamps_and_watermarks(self, ts: str, strategy: str | Strategy = "0 seconds") -> Stream:
        """Sets the event time and the watermark's strategy; a text is the bound of the disorder.

        On a stream the watermark is Spark's, which moves between batches and knows bounds only. The end of its input, at
        which every window fires, is a row that arrives last; sinks of `Environment` see to that.
        """
        s = strategy_of(strategy)
        if not self.df.isStreaming:
            return replace(self, ts=ts, strategy=s)
        if not isinstance(s, Bounded):
            raise ValueError("a streaming DataFrame takes a bound; see processors.stamp_watermark_stream and stamp_batches")
        df, flush = runner.with_flush(self.df, ts)
        return replace(self, df=df.withWatermark(ts, s.delay), ts=ts, strategy=s, flush=flush)

    def key_by(self, *keys: str | Column, name: str = "key") -> KeyedStream:
        """Keys by a column; an expression, or several columns as a struct, becomes the column `name`."""
        if len(keys) == 1 and isinstance(keys[0], str):
            return KeyedStream(self, keys[0])
        key = keys[0] if len(keys) == 1 else F.struct(*keys)
        return KeyedStream(self._with(self.df.withColumn(name, key)), name)

    def set_parallelism(self, n: int) -> Stream:
        return self._with(stateless.set_parallelism(self.df, n))

    def rebalance(self, n: int) -> Stream:
        return self._with(stateless.rebalance(self.df, n, self.order))

    def partition_by(self, channel: Column, n: int) -> Stream:
        """An own partitioner: row r goes to partition `channel` mod n."""
        return self._with(stateless.partition_by(self.df, channel, n))

    def add_sink(self, sink: Callable[[DataFrame], Any]) -> Any:
        """Hands the plan to a sink and returns what it returns; a stream may have many sinks."""
        return sink(self.live())

    def collect(self) -> list[Row]:
        """Rows in arrival order, for small results of a batch."""
        return self.df.orderBy(self.order).collect()

    def live(self) -> DataFrame:
        """The rows without the one that ends a stream's input."""
        if self.flush and self.ts in self.df.columns:
            return self.df.filter(F.col(self.ts) < F.lit(runner.END_OF_TIME).cast(self.df.schema[self.ts].dataType))
        return self.df

    def _watermarked(self) -> DataFrame:
        if self.df.isStreaming or "wm" in self.df.columns:
            return self.df
        return eventtime.watermark_before(self.df, self.ts, [self.order], self.strategy)


@dataclass(frozen=True)
class KeyedStream:
    stream: Stream
    key: str

    def reduce(self, fold: str | Callable[[Any, Any], Any], value: str, name: str = "acc", kind: str = "bigint") -> Stream:
        """A running fold: a named one ('sum', 'min', 'max', 'count') or a Python function of two values."""
        s = self.stream
        if s.df.isStreaming:
            if fold == "count":
                return s._with(processors.running_fold_stream(s.live(), self.key, s.order, s.order, kind, lambda n, _: n + 1, name, lambda _: 1))
            return s._with(processors.running_fold_stream(s.live(), self.key, s.order, value, kind, fold if callable(fold) else FOLDS[fold], name))
        if callable(fold):
            return s._with(keyed.running_fold(s.df, self.key, s.order, value, fold, kind, name))
        return s._with(keyed.running_reduce(s.df, self.key, s.order, fold, value, name))

    def sum(self, value: str, name: str = "sum") -> Stream:
        return self.reduce("sum", value, name)

    def process(self, processor: StatefulProcessor, schema: str, time: str = "none") -> Stream:
        """An own operator on a stream's keys; `time` is none, ProcessingTime or EventTime."""
        s = self.stream
        df = s.df if time == "EventTime" else s.live()
        return s._with(processors.process(df, self.key, processor, schema, time))

    def window(self, windows: Windows) -> WindowedStream:
        return WindowedStream(self, windows)


@dataclass(frozen=True)
class WindowedStream:
    keyed: KeyedStream
    windows: Windows

    def _assigned(self) -> tuple[DataFrame, list[str | Column]]:
        s, key = self.keyed.stream, self.keyed.key
        if s.df.isStreaming:
            if s.ts is None:
                raise ValueError("windows of a stream need an event time")
            return s.df, [self.windows.column(s.ts).alias("w"), key]
        if s.ts is None:
            return s.df, [key]
        assigned = eventtime.assign_windows(s._watermarked(), s.ts, self.windows)
        return eventtime.on_time(assigned), [key, "win_start", "win_end"]

    def _result(self, df: DataFrame) -> Stream:
        s = self.keyed.stream
        if s.df.isStreaming:
            df = df.withColumns({"win_start": F.col("w.start"), "win_end": F.col("w.end")}).drop("w")
        return Stream(df, s.order, flush=s.flush)

    def reduce(self, *aggregates: Column) -> Stream:
        """One row for each key and window, ordered by the window's first arrival. Late (record, window) pairs are dropped.

        Without event time there is one window for each key, as no time ever closes it.
        """
        df, keys = self._assigned()
        return self._result(df.groupBy(*keys).agg(*aggregates, F.min(self.keyed.stream.order).alias(self.keyed.stream.order)))

    def fold(self, item: Column, start: Column, step: Callable[[Column, Column], Column], name: str) -> Stream:
        """A left fold of each key and window in arrival order; the function need not commute."""
        df, keys = self._assigned()
        return self._result(keyed.ordered_fold(df, keys, self.keyed.stream.order, item, start, step, name))


def from_collection(spark: SparkSession, rows: Iterable[Any], schema: str) -> Stream:
    return Stream(collection(spark, rows, schema), ORDER)


def from_table(spark: SparkSession, root: str, name: str, order: str, streaming: bool = False, files_per_batch: int | None = None) -> Stream:
    """A table of Parquet, as a batch or as a stream; streams have times as timestamps with a zone."""
    if not streaming:
        return Stream(read_table(spark, root, name), order)
    runner.enable_state_store(spark)
    df = stream_table(spark, root, name, files_per_batch)
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"}
    return Stream(df.withColumns(zoned) if zoned else df, order)


def from_source(spark: SparkSession, fn: SourceFunction, columns: str, order: str, parallelism: int = 1, streaming: bool = False, step: int = 100, limit: int | None = None) -> Stream:
    """An own source; see `sources.custom`."""
    if streaming:
        runner.enable_state_store(spark)
    return Stream(add_source(spark, fn, columns, parallelism, streaming, step, limit), order)
