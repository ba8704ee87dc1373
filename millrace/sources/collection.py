"""In-memory collections as streams; the position in the collection is the arrival order."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.prefix import ordinal

ORDER = "ord"


def collection(spark: SparkSession, rows: Iterable[Any], schema: str) -> DataFrame:
    """Rows in the given order plus `ord`, their 0-based position. One bare column may be given as plain values."""
    listed = [row if isinstance(row, (tuple, list)) else (row,) for row in rows]
    return spark.createDataFrame([(*row, i) for i, row in enumerate(listed)], f"{schema}, {ORDER} bigint")


def replay_from(df: DataFrame, offset: int, order: str = ORDER) -> DataFrame:
    """What a source emits again after a restore at `offset`: everything behind the first `offset` rows of the order."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    return ordinal(df, order, "__at").filter(F.col("__at") >= offset).drop("__at")


def shard(df: DataFrame, parallelism: int, order: str = ORDER, name: str = "subtask") -> DataFrame:
    """Element i of the order (its position, not its value) belongs to subtask i mod parallelism."""
    if parallelism < 1:
        raise ValueError("parallelism must be at least 1")
    return ordinal(df, order, "__at").withColumn(name, F.pmod("__at", F.lit(parallelism).cast("bigint"))).drop("__at")
