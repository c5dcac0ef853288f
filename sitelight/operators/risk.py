"""Risk score from 0 to 100 with its breakdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelight import schema as S
from sitelight.functions.columns import clamp, completed, holds, kept, null_nan
from sitelight.functions.joins import measured
from sitelight.operators.segments import normalized_delay


def peer_cells(projects: DataFrame) -> DataFrame:
    """Everything scoring needs from other rows, counted once per (portfolio,
    type, region); peer rates and portfolio maxima are rolled up from here."""
    done = completed()
    return measured(
        projects.groupBy("portfolio_id", "project_type", "region").agg(
            F.count_if(done).alias("peers"),
            F.count_if(done & holds(null_nan(F.col("cost_overrun_pct").cast("double")) > S.HIGH_OVERRUN_PCT)).alias("overruns"),
            F.count_if(done & holds(null_nan(F.col("payment_disputes").cast("double")) >= 1)).alias("disputed"),
            F.max(null_nan(F.col("contract_value_usd").cast("double"))).alias("max_value"),
            F.max(null_nan(F.col("subcontractor_count").cast("double"))).alias("max_subs"),
        )
    )


def peer_rate(cells: DataFrame, level: str, hits: str, name: str) -> DataFrame:
    """Share of finished peers with the outcome, per portfolio and ``level``."""
    return (
        cells.groupBy("portfolio_id", level)
        .agg(F.sum("peers").alias("_n"), F.sum(hits).alias("_k"))
        .where("_n > 0")
        .select("portfolio_id", level, (F.col("_k") / F.col("_n")).alias(name))
    )


def portfolio_maxima(cells: DataFrame) -> DataFrame:
    return cells.groupBy("portfolio_id").agg(
        F.max("max_value").alias("_max_value"), F.max("max_subs").alias("_max_subs")
    )


def size_pressure(value: Column, largest: Column) -> Column:
    share = F.least(F.lit(1.0), F.log1p(value) / F.log1p(largest))
    return F.when(value.isNull() | ~holds(largest > 0), 0.0).otherwise(share)


def complexity(subs: Column, most: Column) -> Column:
    cap = F.greatest(F.lit(1.0), F.floor(F.coalesce(most, F.lit(1.0))).cast("double"))
    return F.when(subs.isNull(), 0.0).otherwise(F.least(F.lit(1.0), subs / cap))


def duration_pressure() -> Column:
    """Null where unknown (running work, or no usable duration)."""
    ratio = normalized_delay(F.col("delay_days"), F.col("actual_duration_days"))
    return F.when(completed(), clamp(ratio, 0.0, 1.0))


def subscores(projects: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Adds the five subscores (rounded to 4 digits) and the ``flags`` list."""
    cells = peer_cells(projects) if cells is None else cells
    value = null_nan(F.col("contract_value_usd").cast("double"))
    subs = null_nan(F.col("subcontractor_count").cast("double"))
    unknown = F.lit(S.UNKNOWN_RISK)
    return (
        projects.join(peer_rate(cells, "project_type", "overruns", "_type"), ["portfolio_id", "project_type"], "left")
        .join(peer_rate(cells, "region", "disputed", "_region"), ["portfolio_id", "region"], "left")
        .join(portfolio_maxima(cells), "portfolio_id", "left")
        .withColumn("_duration", duration_pressure())
        .withColumns(
            {
                "type_risk": F.bround(F.coalesce("_type", unknown), 4),
                "region_risk": F.bround(F.coalesce("_region", unknown), 4),
                "size_risk": F.bround(size_pressure(value, F.col("_max_value")), 4),
                "complexity_risk": F.bround(complexity(subs, F.col("_max_subs")), 4),
                "duration_risk": F.bround(F.coalesce("_duration", unknown), 4),
                "flags": kept(
                    (F.col("_type").isNull(), "sparse_type"),
                    (F.col("_region").isNull(), "sparse_region"),
                    (F.col("_duration").isNull(), "unknown_duration"),
                ),
            }
        )
        .drop("_type", "_region", "_max_value", "_max_subs", "_duration")
    )


def composite() -> Column:
    """Weighted sum in dimension order, as a whole number from 0 to 100."""
    parts = [F.col(d) * S.RISK_WEIGHT for d in S.RISK_DIMENSIONS]
    total = reduce(lambda a, b: a + b, parts)
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(total * 100).cast("int")))


def top_driver() -> Column:
    """Dimension with the largest subscore; the earlier one wins a tie."""
    highest = F.greatest(*S.RISK_DIMENSIONS)
    return F.coalesce(*[F.when(F.col(d) == highest, F.lit(d)) for d in S.RISK_DIMENSIONS])


def scores(projects: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """portfolio_id, project_id, score, breakdown."""
    weights = F.struct(*[F.lit(S.RISK_WEIGHT).alias(d) for d in S.RISK_DIMENSIONS])
    return subscores(projects, cells).select(
        "portfolio_id",
        "project_id",
        composite().alias("score"),
        F.struct(
            F.struct(*S.RISK_DIMENSIONS).alias("subscores"),
            weights.alias("weights"),
            top_driver().alias("top_driver"),
            F.col("flags"),
        ).alias("breakdown"),
    )


def contributions(scored: DataFrame) -> DataFrame:
    """One row per project and dimension: points contributed, largest first."""
    parts = F.array(
        *[
            F.struct(
                (F.col(f"breakdown.subscores.{d}") * F.col(f"breakdown.weights.{d}") * 100).alias("points"),
                F.lit(-i).alias("tie"),
                F.lit(d).alias("dimension"),
            )
            for i, d in enumerate(S.RISK_DIMENSIONS)
        ]
    )
    # Five entries per project are ordered inside the row: no shuffle.
    ordered = F.sort_array(parts, asc=False)
    return scored.select(
        "portfolio_id", "project_id", F.posexplode(ordered).alias("_pos", "_part")
    ).select(
        "portfolio_id", "project_id", (F.col("_pos") + 1).alias("position"),
        "_part.dimension", "_part.points",
    )


def risk_band(score: Column) -> Column:
    return F.when(score <= 34, "success").when(score <= 64, "warning").when(score.isNotNull(), "destructive")
