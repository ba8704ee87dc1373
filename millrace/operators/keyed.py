"""Keyed reduces and the batch views of keyed state.

A keyed reduce is a running fold: it emits a row for each input row, in arrival order within the key. The algebraic
forms are window functions; an arbitrary function of two values runs once per key over Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folds that a window function computes.
ALGEBRAIC = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def _running(key: str, order: str):  # noqa: ANN202
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_reduce(df: DataFrame, key: str, order: str, fold: str, value: str, name: str) -> DataFrame:
    """Adds the running sum, min, max or count of `value` within the key up to and including this row."""
    if fold not in ALGEBRAIC:
        raise ValueError(f"fold must be one of {sorted(ALGEBRAIC)}")
    return df.withColumn(name, ALGEBRAIC[fold](value).over(_running(key, order)))


def running_sum(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    return running_reduce(df, key, order, "sum", value, name)


def final_reduce(df: DataFrame, key: str, fold: str, value: str, name: str) -> DataFrame:
    """The last value of the running fold of each key; partial aggregates run before the exchange."""
    if fold not in ALGEBRAIC:
        raise ValueError(f"fold must be one of {sorted(ALGEBRAIC)}")
    return df.groupBy(key).agg(ALGEBRAIC[fold](value).alias(name))


def running_best(df: DataFrame, key: str, order: str, value: str, fields: list[str], prefix: str = "best_") -> DataFrame:
    """The record with the largest value so far, whole; of equal values the earlier one stays."""
    rank = F.struct(F.col(value), -F.col(order))
    best = F.max_by(F.struct(*fields), rank).over(_running(key, order))
    return df.withColumn("__best", best).select("*", *[F.col(f"__best.{f}").alias(prefix + f) for f in fields]).drop("__best")


def ordered_fold(df: DataFrame, keys: str | list[str | Column], order: str, item: Column, start: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """A left fold in arrival order for each key (or key and window) with a column function, commutative or not.

    The items of a key are collected, so it is for keys, or keys and windows, of bounded size; `final_reduce` has no such
    bound, and `last_of_fold` folds a key of any size with a Python function.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v"))))
    keys = [keys] if isinstance(keys, str) else keys
    return df.groupBy(*keys).agg(F.aggregate(items, start, lambda acc, x: step(acc, x["v"])).alias(name), F.min(order).alias(order))


def running_fold(df: DataFrame, key: str, order: str, value: str, fn: Callable[[Any, Any], Any], kind: str, name: str) -> DataFrame:
    """The running fold with an opaque Python function; the first record of a key passes through.

    Rows of a key stream through in order, so a hot key costs time in one task but no memory.
    """
    from pyspark.sql.types import StructType

    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, acc = object(), None
        for batch in batches:
            out = []
            for k, v in zip(batch[key], batch[value], strict=True):
                same = k == last or (pd.isna(k) and last is None)
                acc = fn(acc, v) if same and acc is not None else v
                last = None if pd.isna(k) else k
                out.append(acc)
            yield batch[names].assign(**{name: out})

    return df.repartition(F.col(key)).sortWithinPartitions(key, order).mapInPandas(run, schema)


def last_of_fold(df: DataFrame, keys: list[str], order: str, value: str, fn: Callable[[Any, Any], Any], kind: str, name: str) -> DataFrame:
    """The last value of an opaque fold in arrival order for each of the keys: rows stream through, one key at a time."""
    from pyspark.sql.types import StructType

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = StructType.fromDDL(f"{kinds}, `{name}` {kind}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, acc = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch[k] for k in keys), batch[value], strict=True):
                key = tuple(None if pd.isna(x) else x for x in row[:-1])
                if key != last:
                    if last is not None:
                        out.append((*last, acc))
                    last, acc = key, row[-1]
                else:
                    acc = fn(acc, row[-1])
            yield pd.DataFrame(out, columns=schema.names)
        if last is not None:
            yield pd.DataFrame([(*last, acc)], columns=schema.names)

    return df.select(*keys, order, value).repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def previous_value(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """What a value state holds when a row arrives: the key's previous value, null at first."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def list_state(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """What a list state holds at the end: the key's values in arrival order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(items, lambda x: x["v"]).alias(name))


def map_state_counts(df: DataFrame, key: str, entry: str, name: str) -> DataFrame:
    """What a map state of counters holds at the end, one row for each entry."""
    return df.groupBy(key, entry).agg(F.count(F.lit(1)).alias(name))


def first_and_last(df: DataFrame, key: str, order: str, value: str, first: str, last: str) -> DataFrame:
    """The record that seeds the reduce and the one that ends it."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(first), F.max_by(value, order).alias(last))
