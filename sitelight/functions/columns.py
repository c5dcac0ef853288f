"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelight import schema as S

# What counts as a number in a text cell. A plain cast also takes type suffixes
# such as ``12d``, which are not numbers to a CSV user.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def null_nan(value: Column) -> Column:
    """NaN sorts above every number in Spark, so it must become null on entry."""
    return F.when(~F.isnan(value), value)


def to_number(text: Column) -> Column:
    """Double for numeric text, null for anything else."""
    return F.when(text.rlike(NUMBER_PATTERN), null_nan(F.trim(text).try_cast("double")))


def to_iso_date(text: Column) -> Column:
    return F.when(
        F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim(text), "yyyy-MM-dd")
    )


def to_whole(value: Column) -> Column:
    """Half-even to an integer; null and NaN stay null."""
    return F.bround(null_nan(value.cast("double"))).cast("int")


def completed() -> Column:
    return F.coalesce(F.col("final_status") == S.COMPLETED, F.lit(False))


def holds(predicate: Column) -> Column:
    """A predicate over null never holds."""
    return F.coalesce(predicate, F.lit(False))


def clamp(value: Column, low: float, high: float) -> Column:
    """Null-keeping clamp (``least``/``greatest`` alone would skip the null)."""
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNotNull(), bounded)


def wilson_interval(hits: Column, trials: Column, z: float = S.Z_95) -> tuple[Column, Column]:
    """Wilson score bounds of ``hits`` out of ``trials``; (0, 0) without trials."""
    n = trials.cast("double")
    k = F.greatest(F.lit(0.0), F.least(hits.cast("double"), n))
    middle = (k + z * z / 2) / (n + z * z)
    spread = F.sqrt(k * (n - k) / n + z * z / 4) * z / (n + z * z)
    some = trials > 0
    low = F.when(some, F.greatest(F.lit(0.0), middle - spread)).otherwise(0.0)
    high = F.when(some, F.least(F.lit(1.0), middle + spread)).otherwise(0.0)
    return low, high


def confidence_label(trials: Column) -> Column:
    return F.when(trials < 3, "low").when(trials < 6, "medium").otherwise("high")


def literal_lookup(key: Column, mapping: dict) -> Column:
    """``when`` chain over a fixed dictionary; unknown keys give null."""
    chain = None
    for name, value in mapping.items():
        chain = F.when(key == name, value) if chain is None else chain.when(key == name, value)
    return chain


def kept(*tests: tuple[Column, str]) -> Column:
    """Array of the labels whose test holds, in the order given."""
    return F.array_compact(F.array(*[F.when(holds(test), F.lit(label)) for test, label in tests]))


def finite(value: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
