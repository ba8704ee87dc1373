"""map, flatMap, filter and exchange as DataFrame transformations.

Columns stay in the JVM. Opaque Python functions run over Arrow batches in `map_rows` and `flat_map_rows`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.prefix import ordinal


def map_columns(df: DataFrame, keep: Iterable[str] = (), **columns: Column) -> DataFrame:
    """One row out for each row in: the columns to keep, then the computed ones."""
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def flat_map(df: DataFrame, items: Column, name: str, keep: Iterable[str] = ()) -> DataFrame:
    """A row for each element of the array `items`; rows with an empty or null array give none."""
    return df.select(*keep, F.explode(items).alias(name))


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose condition is true."""
    return df.filter(condition)


def _record_batches(fn: Callable[[dict], Iterable[tuple]], names: list[str]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [row for record in batch.to_dict("records") for row in fn(record)]
            yield pd.DataFrame(out, columns=names)

    return run


def map_rows(df: DataFrame, fn: Callable[[dict], tuple], schema: str) -> DataFrame:
    """An opaque function of one record, over Arrow batches."""
    return flat_map_rows(df, lambda record: (fn(record),), schema)


def flat_map_rows(df: DataFrame, fn: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """An opaque function that yields any number of tuples for a record, over Arrow batches."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    return df.mapInPandas(_record_batches(fn, kind.names), kind)


def filter_records(df: DataFrame, fn: Callable[[dict], Any]) -> DataFrame:
    """Keeps the rows for which an opaque predicate is true."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[bool(fn(r)) for r in batch.to_dict("records")]]

    return df.mapInPandas(run, df.schema)


def set_parallelism(df: DataFrame, n: int) -> DataFrame:
    """Round-robin over n partitions."""
    if n < 1:
        raise ValueError("parallelism must be at least 1")
    return df.repartition(n)


def partition_by(df: DataFrame, channel: Column, n: int) -> DataFrame:
    """Row r goes to partition `channel` mod n; a null channel goes to partition 0."""
    if n < 1:
        raise ValueError("parallelism must be at least 1")
    return df.repartitionById(n, F.pmod(F.coalesce(channel.cast("bigint"), F.lit(0)), F.lit(n).cast("bigint")).cast("int"))


def rebalance(df: DataFrame, n: int, order: str, name: str = "channel") -> DataFrame:
    """Round-robin in arrival order as a visible column: row k of the order goes to channel k mod n."""
    if n < 1:
        raise ValueError("parallelism must be at least 1")
    return ordinal(df, order, "__ordinal").withColumn(name, F.pmod("__ordinal", F.lit(n).cast("bigint"))).drop("__ordinal")
