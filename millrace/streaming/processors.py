"""Stateful processors: keyed state, timers and watermarks on streams.

Spark gives no order of rows within a batch, so each processor sorts its key's rows of the batch by arrival before it
folds them. State is read once for each key and batch, worked on in memory, and written once. What is held is a key's
rows of one batch; `maxFilesPerTrigger` bounds that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from millrace.operators.eventtime import Strategy, delay_of, strategy_of
from millrace.operators.prefix import running_max_before


def _sorted(rows: Iterator[pd.DataFrame], order: str | list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order)


def _frame(**columns: list) -> pd.DataFrame:
    """Columns of plain objects: texts must not become columns of another library's arrays."""
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})


class RunningFold(StatefulProcessor):
    """Running fold of one column: value state `acc`, a row out for each row in, with the fold as a further column.

    The first value passes through `first`.
    """

    def __init__(self, order: str, value: str, kind: str, fn: Callable[[Any, Any], Any], name: str, first: Callable[[Any], Any] = lambda v: v) -> None:
        self.order, self.value, self.kind, self.fn, self.name, self.first = order, value, kind, fn, name, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.acc = handle.getValueState("acc", f"v {self.kind}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _sorted(rows, self.order)
        acc = self.acc.get()[0] if self.acc.exists() else None
        out = []
        for v in batch[self.value].tolist():
            acc = self.first(v) if acc is None else self.fn(acc, v)
            out.append(acc)
        self.acc.update((acc,))
        yield batch.assign(**{self.name: out})

    def close(self) -> None:
        pass


class KeyedViews(StatefulProcessor):
    """Value, list and map state of one key: previous value, all values so far, count of each value."""

    def __init__(self, key: str, order: str, value: str) -> None:
        self.key, self.order, self.value = key, order, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "v string")
        self.all = handle.getListState("all", "v string")
        self.counts = handle.getMapState("counts", "k string", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _sorted(rows, self.order)
        values = batch[self.value].tolist()
        previous = self.last.get()[0] if self.last.exists() else None
        counts = {v: self.counts.getValue((v,))[0] if self.counts.containsKey((v,)) else 0 for v in set(values)}
        out = []
        for o, v in zip(batch[self.order].tolist(), values, strict=True):
            counts[v] += 1
            out.append((key[0], o, previous, counts[v]))
            previous = v
        self.all.appendList([(v,) for v in values])
        for v, n in counts.items():
            self.counts.updateValue((v,), (n,))
        self.last.update((previous,))
        yield pd.DataFrame(out, columns=[self.key, self.order, "previous", "times"])

    def close(self) -> None:
        pass


class Groups(StatefulProcessor):
    """A list state that is read and cleared: every `size` values of a key, in arrival order, are a row."""

    def __init__(self, key: str, order: str, value: str, size: int) -> None:
        self.key, self.order, self.value, self.size = key, order, value, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "v string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        values = [v for (v,) in self.held.get()] if self.held.exists() else []
        values += _sorted(rows, self.order)[self.value].tolist()
        full = len(values) // self.size * self.size
        self.held.clear()
        if values[full:]:
            self.held.put([(v,) for v in values[full:]])
        items = [",".join(values[i : i + self.size]) for i in range(0, full, self.size)]
        yield _frame(**{self.key: [key[0]] * len(items), "items": items})

    def close(self) -> None:
        pass


#: A watermark strategy on a stream: state (null at first) and event time give the new state; state gives the watermark.
Advance = Callable[[int | None, int], int]
Current = Callable[[int | None], int | None]


class StampWatermark(StatefulProcessor):
    """Stamps each row with the watermark that held when it arrived, from one value state per clock.

    For strategies that are any pair of functions on a 64-bit state. A clock is one sequence; keep a clock per source
    partition. `stamp_batches` has no such bound.
    """

    def __init__(self, order: list[str], ts: str, advance: Advance, current: Current) -> None:
        self.order, self.ts, self.advance, self.current = order, ts, advance, current

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "v bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _sorted(rows, self.order)
        state = self.state.get()[0] if self.state.exists() else None
        stamps: list[int | None] = []
        for t in batch[self.ts].tolist():
            stamps.append(self.current(state))
            state = self.advance(state, t)
        self.state.update((state,))
        yield batch.assign(wm_us=pd.array(stamps, dtype="Int64"))

    def close(self) -> None:
        pass


class EventTimers(StatefulProcessor):
    """Counts per window of a key, emitted by event-time timers in the order of the windows' ends.

    The ends and counts that wait are one value state; one timer waits for the earliest end.
    """

    def __init__(self, key: str, ts_ms: str, size_ms: int) -> None:
        self.key, self.ts_ms, self.size_ms = key, ts_ms, size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "ends array<bigint>, counts array<bigint>")

    def _waiting(self) -> dict[int, int]:
        if not self.waiting.exists():
            return {}
        ends, counts = self.waiting.get()
        return dict(zip((int(e) for e in ends), (int(n) for n in counts), strict=True))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = self._waiting()
        before = min(waiting, default=None)
        for batch in rows:
            ends = (batch[self.ts_ms] // self.size_ms + 1) * self.size_ms
            for end, n in ends.value_counts().items():
                waiting[int(end)] = waiting.get(int(end), 0) + int(n)
        first = min(waiting)
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(first)
        self.waiting.update((list(waiting), list(waiting.values())))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, now = self._waiting(), timerValues.getCurrentWatermarkInMs()
        due = sorted(end for end in waiting if end <= now)
        rest = {end: n for end, n in waiting.items() if end > now}
        if rest:
            self.waiting.update((list(rest), list(rest.values())))
            self.handle.registerTimer(min(rest))
        else:
            self.waiting.clear()
        yield _frame(**{self.key: [key[0]] * len(due), "end_ms": due, "n": [waiting[e] for e in due]})

    def close(self) -> None:
        pass


class IdleTimers(StatefulProcessor):
    """A timer that is deleted and set anew: emits a key once no row came for `gap_ms` of event time."""

    def __init__(self, key: str, ts_ms: str, gap_ms: int) -> None:
        self.key, self.ts_ms, self.gap_ms = key, ts_ms, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "t bigint, n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        at, n = self.at.get() if self.at.exists() else (None, 0)
        if at is not None and at <= timerValues.getCurrentWatermarkInMs():  # it is due, before this batch's rows count
            yield _frame(**{self.key: [key[0]], "end_ms": [at], "n": [n]})
            self.handle.deleteTimer(int(at))
            at, n = None, 0
        new = int(batch[self.ts_ms].max()) + self.gap_ms
        if at is None or new > at:
            if at is not None:
                self.handle.deleteTimer(int(at))
            self.handle.registerTimer(new)
            at = new
        self.at.update((int(at), int(n) + len(batch)))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, n = self.at.get()
        self.at.clear()
        yield _frame(**{self.key: [key[0]], "end_ms": [at], "n": [n]})

    def close(self) -> None:
        pass


def process(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str | StructType, time: str = "none") -> DataFrame:
    """An own operator: any stateful processor over the stream's keys. `time` is none, ProcessingTime or EventTime."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=kind, outputMode="append", timeMode=time)


def _kind(stream: DataFrame, column: str) -> str:
    return stream.schema[column].dataType.simpleString()


def running_fold_stream(stream: DataFrame, key: str, order: str, value: str, kind: str, fn: Callable[[Any, Any], Any], name: str = "acc", first: Callable[[Any], Any] = lambda v: v) -> DataFrame:
    """The streaming face of a keyed reduce: all columns and the fold."""
    schema = StructType([*stream.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])
    return process(stream, key, RunningFold(order, value, kind, fn, name, first), schema)


def keyed_views_stream(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    schema = f"{key} {_kind(stream, key)}, {order} {_kind(stream, order)}, previous string, times bigint"
    return process(stream, key, KeyedViews(key, order, value), schema)


def groups_stream(stream: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """(key, items): every `size` values of a key in arrival order."""
    return process(stream, key, Groups(key, order, value, size), f"{key} {_kind(stream, key)}, items string")


def stamp_watermark_stream(stream: DataFrame, order: list[str], ts_us: str, strategy: tuple[Advance, Current], clock: str) -> DataFrame:
    """Adds `wm_us`, the watermark in microseconds that held before each row of the same clock."""
    schema = StructType([*stream.schema.fields, *StructType.fromDDL("wm_us bigint").fields])
    return process(stream, clock, StampWatermark(order, ts_us, *strategy), schema)


def timer_counts_stream(stream: DataFrame, key: str, ts: str, ts_ms: str, size_ms: int, delay: str) -> DataFrame:
    """Counts per key and window, emitted by event-time timers."""
    return process(stream.withWatermark(ts, delay), key, EventTimers(key, ts_ms, size_ms), f"{key} {_kind(stream, key)}, end_ms bigint, n bigint", "EventTime")


def idle_keys_stream(stream: DataFrame, key: str, ts: str, ts_ms: str, gap_ms: int, delay: str) -> DataFrame:
    """(key, end_ms, n): keys without a row for a gap, with the rows before it; each row of a key moves its timer."""
    return process(stream.withWatermark(ts, delay), key, IdleTimers(key, ts_ms, gap_ms), f"{key} {_kind(stream, key)}, end_ms bigint, n bigint", "EventTime")


def stamp_batches(out: str, order: list[str], ts: str, strategy: str | Strategy, name: str = "wm") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stamps each row with the exact watermark before it, without a key.

    Within a batch ranges of the arrival order are folded on their own; the largest mark of earlier batches is one row a
    batch. Batches must come in arrival order. Batch n goes to `<out>/rows/batch=n`, which a replay overwrites.
    """
    s = strategy_of(strategy)

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        top = batch.agg(F.max(s.mark(ts)).alias("top"))
        top.write.mode("overwrite").parquet(f"{out}/tops/batch={n}")
        tops = spark.read.schema(StructType([*top.schema.fields, *StructType.fromDDL("batch bigint").fields])).parquet(f"{out}/tops")
        carry: Column = F.lit(tops.filter(F.col("batch") < n).agg(F.max("top")).first()[0]).cast(top.schema["top"].dataType)
        rows = running_max_before(batch, s.mark(ts), order, name).withColumn(name, F.greatest(F.col(name), carry) - delay_of(s.delay))
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    return write


def stamped(spark, out: str, schema: StructType, ts: str, name: str = "wm") -> DataFrame:  # noqa: ANN001
    """The rows that `stamp_batches` has written."""
    kind = StructType([*schema.fields, *StructType.fromDDL(f"{name} {schema[ts].dataType.simpleString()}, batch bigint").fields])
    return spark.read.schema(kind).parquet(f"{out}/rows").drop("batch")
