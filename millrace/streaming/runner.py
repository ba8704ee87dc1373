"""Runs a bounded stream to its end, with flush, restart policy and sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.session import ROCKSDB, shared_dir

#: A time far behind all data; one row with it at the end closes every open window.
END_OF_TIME = "2262-01-01 00:00:00"


def enable_state_store(spark: SparkSession) -> None:
    """The stateful processors want the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@dataclass(frozen=True)
class Flush:
    """The end of input: a row whose time is far behind all others. It must not arrive before all data has, or all later
    batches would be late; so its folder stays empty until `close`."""

    row: DataFrame
    path: str

    def close(self) -> None:
        self.row.coalesce(1).write.mode("overwrite").parquet(self.path)


def with_flush(stream: DataFrame, ts: str, **columns: object) -> tuple[DataFrame, Flush]:
    """The stream with a source for its flush row, to be put below the watermark, and the row.

    Its own window never closes, so it leaves no output of its own.
    """
    spark, path, casts = stream.sparkSession, shared_dir(stream.sparkSession, "flush"), []
    for field in stream.schema.fields:
        value = END_OF_TIME if field.name == ts else columns.get(field.name)
        literal = "NULL" if value is None else f"'{value}'"
        casts.append(f"CAST({literal} AS {field.dataType.simpleString()}) AS `{field.name}`")
    row = spark.sql(f"SELECT {', '.join(casts)}")
    row.limit(0).write.parquet(path)  # the folder, without a row
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path)), Flush(row, path)


def run_to_parquet(
    stream: DataFrame, checkpoint: str | None = None, out: str | None = None, mode: str = "append", flush: Flush | None = None, max_restarts: int = 0, interval_ms: int | None = None
) -> DataFrame:
    """Runs all available input into a Parquet sink and returns the sink's table. The sink is exactly-once.

    With a flush, the data runs to its end first; then the flush row arrives in a second run on the same checkpoint.
    With an interval, batches begin that often (a checkpoint each); without, one follows the other.
    """
    spark = stream.sparkSession
    out, checkpoint = out or shared_dir(spark, "sink"), checkpoint or shared_dir(spark, "checkpoint")

    def start(_: int) -> StreamingQuery:
        writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out)
        return (writer.trigger(processingTime=f"{interval_ms} milliseconds") if interval_ms else writer.trigger(availableNow=True)).start()

    run_with_restarts(start, max_restarts, bounded=not interval_ms)
    if flush:
        flush.close()
        run_with_restarts(start, max_restarts, bounded=not interval_ms)
    return spark.read.schema(stream.schema).parquet(out)


def run_with_restarts(start: Callable[[int], StreamingQuery], max_restarts: int = 3, bounded: bool = True) -> int:
    """Starts the query and, when it fails, starts it again on the same checkpoint.

    `start(attempt)` must return a started query; one that does not end by itself (`bounded` is false) is stopped when all
    input that was there is done. Returns the number of restarts; when they are used up the last failure is raised.
    Committed batches are not run again and state comes from the checkpoint.
    """
    if max_restarts < 0:
        raise ValueError("max_restarts must not be negative")
    for attempt in range(max_restarts + 1):
        query = start(attempt)
        try:
            if bounded:
                query.awaitTermination()
            else:
                query.processAllAvailable()
                query.stop()
            return attempt
        except Exception:
            query.stop()
            if attempt == max_restarts:
                raise
    raise AssertionError("unreachable")
