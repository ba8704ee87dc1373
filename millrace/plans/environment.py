"""One place for a job's sources, checkpoints and restarts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import stream as plans
from millrace.plans.stream import Stream
from millrace.session import shared_dir
from millrace.sources.custom import SourceFunction
from millrace.streaming import runner


@dataclass
class Environment:
    """Settings of a job; they hold for every `execute` behind them."""

    spark: SparkSession
    interval_ms: int | None = None
    max_restarts: int = 3

    def from_collection(self, rows: Iterable[Any], schema: str) -> Stream:
        return plans.from_collection(self.spark, rows, schema)

    def from_table(self, root: str, name: str, order: str, streaming: bool = False, files_per_batch: int | None = None) -> Stream:
        return plans.from_table(self.spark, root, name, order, streaming, files_per_batch)

    def add_source(self, fn: SourceFunction, columns: str, order: str, parallelism: int = 1, streaming: bool = False, step: int = 100, limit: int | None = None) -> Stream:
        return plans.from_source(self.spark, fn, columns, order, parallelism, streaming, step, limit)

    def enable_checkpointing(self, interval_ms: int) -> Environment:
        """Batches of streams, and with them checkpoints, begin every so many milliseconds."""
        if interval_ms < 1:
            raise ValueError("the interval must be at least 1 ms")
        self.interval_ms = interval_ms
        return self

    def set_max_restarts(self, n: int) -> Environment:
        if n < 0:
            raise ValueError("max_restarts must not be negative")
        self.max_restarts = n
        return self

    def execute(self, stream: Stream, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
        """Runs a stream to the end of its input and returns the table it was written to.

        A failed stream starts again on its checkpoint, up to `max_restarts` times; all windows fire at the end. A batch is
        written once; Spark tries failed tasks of it again.
        """
        df = stream.live()
        if df.isStreaming:
            return runner.run_to_parquet(df, checkpoint, out, flush=stream.flush, max_restarts=self.max_restarts, interval_ms=self.interval_ms)
        out = out or shared_dir(self.spark, "sink")
        df.write.parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)
