"""User-written sources as a Python data source, for batch and for streams.

A source is a function `fn(subtask, parallelism, start)` that yields tuples in a fixed order, from element `start` on; a
function of two arguments always begins at element 0, and what comes before the offset is skipped, so it suits sources
of a few batches. Each subtask is one input partition. Its position in the function's output is the offset, so a replay
after a failure skips what was committed.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SourceFunction = Callable[..., Iterator[tuple]]


def _from(fn: SourceFunction, subtask: int, parallelism: int, start: int) -> Iterator[tuple]:
    if len(inspect.signature(fn).parameters) > 2:
        return iter(fn(subtask, parallelism, start))
    return islice(fn(subtask, parallelism), start, None)


class _Slice(InputPartition):
    def __init__(self, subtask: int, start: int = 0, end: int | None = None) -> None:
        super().__init__(subtask)
        self.subtask, self.start, self.end = subtask, start, end


def _load(options: dict) -> tuple[SourceFunction, int]:
    return cloudpickle.loads(bytes.fromhex(options["fn"])), int(options["parallelism"])


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.fn, self.parallelism = _load(options)

    def partitions(self) -> list[InputPartition]:
        return [_Slice(i) for i in range(self.parallelism)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from _from(self.fn, partition.subtask, self.parallelism, 0)


class _StreamReader(DataSourceStreamReader):
    """Advances every subtask by `step` elements a batch until `limit`."""

    def __init__(self, options: dict) -> None:
        self.fn, self.parallelism = _load(options)
        self.step, self.limit = int(options["step"]), int(options["limit"])
        self.at = 0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.at + self.step, self.limit)
        return {"n": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["n"])
        return [_Slice(i, start["n"], end["n"]) for i in range(self.parallelism)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from islice(_from(self.fn, partition.subtask, self.parallelism, partition.start), partition.end - partition.start)


class FunctionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_function"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _StreamReader(self.options)


def add_source(
    spark: SparkSession,
    fn: SourceFunction,
    columns: str,
    parallelism: int = 1,
    streaming: bool = False,
    step: int = 100,
    limit: int | None = None,
) -> DataFrame:
    """The rows that `fn` yields in each subtask, as a batch or as a stream of `step` rows per subtask and batch.

    A stream needs `limit`, the number of elements of a subtask after which it ends; the batch ends with the function.
    """
    if parallelism < 1:
        raise ValueError("parallelism must be at least 1")
    if streaming and limit is None:
        raise ValueError("a stream needs a limit")
    spark.dataSource.register(FunctionSource)
    reader = spark.readStream if streaming else spark.read
    return (
        reader.format(FunctionSource.name())
        .option("fn", cloudpickle.dumps(fn).hex())
        .option("columns", columns)
        .option("parallelism", str(parallelism))
        .option("step", str(step))
        .option("limit", str(limit or 0))
        .load()
    )
