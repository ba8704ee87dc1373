"""Sinks: collected rows, per-record functions and batch tables that a replay overwrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StreamingQuery


def collect_sink(df: DataFrame) -> list[Row]:
    """All rows of a finished job as an independent list. For small results only; use a table sink otherwise."""
    return list(df.collect())


def for_each(df: DataFrame, fn: Callable[[Row], None], checkpoint: str | None = None) -> StreamingQuery | None:
    """Calls a function for each record, at least once. On a stream it returns the started query."""
    if not df.isStreaming:
        df.foreach(fn)
        return None
    writer = df.writeStream.foreach(fn).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def batch_table(path: str, before: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes batch n to `<path>/batch=n`, overwriting what a failed try left there.

    `before(n)` runs between the write and the commit; tests fail there.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if before:
            before(n)

    return write
