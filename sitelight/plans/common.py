"""Helpers that turn results into comparable scalar columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Reals rounded; ``special`` sets the digits of single columns."""
    return df.withColumns(
        {c: F.round(c, special.get(c, digits)) for c, t in df.dtypes if t == "double"}
    )


def joined(column: str):
    return F.array_join(column, ",").alias(column)
