"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column | str, separator: str = " ") -> Column:
    """Array of the non-empty pieces between separators; null text has none."""
    col = F.col(text) if isinstance(text, str) else text
    literal = f"\\Q{separator}\\E"
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), literal), "")


def threshold_status(value: Column | str, limit: float) -> Column:
    """'alert' from the limit on, else 'normal'; null where the value is null."""
    col = F.col(value) if isinstance(value, str) else value
    return F.when(col >= limit, F.lit("alert")).when(col < limit, F.lit("normal"))
