"""Outcome rates per segment, with Wilson intervals, and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelight import schema as S
from sitelight.functions.columns import (
    completed, confidence_label, holds, literal_lookup, null_nan, wilson_interval,
)
from sitelight.operators.segments import size_bucket


def outcome_predicates() -> dict[str, Column]:
    def number(name: str) -> Column:
        return null_nan(F.col(name).cast("double"))

    return {
        "high_overrun": holds(number("cost_overrun_pct") > S.HIGH_OVERRUN_PCT),
        "high_delay": holds(number("delay_days") > S.HIGH_DELAY_DAYS),
        "any_safety_incident": holds(number("safety_incidents") >= 1),
        "any_dispute": holds(number("payment_disputes") >= 1),
    }


def rules(projects: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Emitted rules of every portfolio.

    Rows are first counted per (portfolio, type, region, bucket) with map-side
    combine; the three scopes are then read off those few cells, so the facts
    are scanned once and no scope multiplies them. Without a segment table the
    bucket is derived from the row itself, which saves the join.
    """
    predicates = outcome_predicates()
    finished = projects.where(completed())
    if segments is None:
        bucketed = finished.withColumn("size_bucket", size_bucket(F.col("contract_value_usd")))
    else:
        bucketed = finished.join(
            segments.select("portfolio_id", "project_id", "size_bucket"),
            ["portfolio_id", "project_id"], "left",
        )
    cells = (
        bucketed.groupBy("portfolio_id", *S.SCOPES)
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(p).alias(o) for o, p in predicates.items()])
    )
    return rules_from_cells(cells)


def emitted(hits: Column, trials: Column) -> Column:
    """Enough trials to be informative, or an absolute outcome."""
    return (trials >= 3) | (hits == 0) | (hits == trials)


def rules_from_cells(cells: DataFrame) -> DataFrame:
    scopes = F.array(
        *[F.struct(F.lit(s).alias("scope_column"), F.col(s).cast("string").alias("scope_value")) for s in S.SCOPES]
    )
    outcome_rows = F.array(
        *[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("hits")) for o in S.OUTCOMES]
    )
    grid = (
        cells.select("portfolio_id", "n", *S.OUTCOMES, F.inline(scopes))
        .where("scope_value is not null")
        .groupBy("portfolio_id", "scope_column", "scope_value")
        .agg(F.sum("n").alias("sample_size"), *[F.sum(o).alias(o) for o in S.OUTCOMES])
        .select("portfolio_id", "scope_column", "scope_value", "sample_size", F.inline(outcome_rows))
        .where(emitted(F.col("hits"), F.col("sample_size")))
    )
    low, high = wilson_interval(F.col("hits"), F.col("sample_size"))
    return grid.select(
        "portfolio_id",
        F.concat_ws("=", "scope_column", "scope_value").alias("scope"),
        "outcome",
        F.bround(F.col("hits") / F.col("sample_size"), 4).alias("rate"),
        "sample_size",
        F.bround(low, 4).alias("ci_low"),
        F.bround(high, 4).alias("ci_high"),
        confidence_label(F.col("sample_size")).alias("confidence"),
    )


def baselines(rules: DataFrame) -> DataFrame:
    """Sample-weighted rate per portfolio and outcome."""
    return rules.groupBy("portfolio_id", "outcome").agg(
        (F.sum(F.col("rate") * F.col("sample_size")) / F.sum("sample_size")).alias("baseline")
    )


def with_salience(rules: DataFrame) -> DataFrame:
    weight = literal_lookup(F.col("confidence"), {k: F.lit(v) for k, v in S.CONFIDENCE_MULTIPLIER.items()})
    return rules.join(baselines(rules), ["portfolio_id", "outcome"], "left").withColumn(
        "salience", F.abs(F.col("rate") - F.col("baseline")) * weight * F.sqrt("sample_size")
    )


def top_signals(rules: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` most salient rules per portfolio; 12 for the full list, 5 for
    an overview. Equal salience (to 9 digits) falls back to scope, outcome."""
    order = W.partitionBy("portfolio_id").orderBy(
        F.round("salience", 9).desc(), F.col("scope"), F.col("outcome")
    )
    return (
        with_salience(rules).withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
    )


def fired_rules(rules: DataFrame) -> DataFrame:
    """Rules far enough from even odds to explain an anomaly, strongest first."""
    distance = F.abs(F.col("rate") - 0.5)
    return rules.where("rate >= 0.5 or (rate <= 0.2 and sample_size >= 3)").orderBy(
        "portfolio_id", distance.desc(), "scope", "outcome"
    )


def listed_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy("portfolio_id", F.desc("sample_size"), F.desc("rate"), "scope", "outcome")


def insights(rules: DataFrame) -> DataFrame:
    """Wording and comparison of each rule."""
    name = F.substring_index("scope", "=", 1)
    value = F.trim(F.expr("substring(scope, instr(scope, '=') + 1)"))
    subject = (
        F.when(F.instr("scope", "=") == 0, F.col("scope"))
        .when(name == "size_bucket", F.concat(value, F.lit(" size-bucket")))
        .when(name == "region", F.concat(value, F.lit(" region")))
        .when(name == "project_type", value)
        .otherwise(F.concat(value, F.lit(" ("), name, F.lit(")")))
    )
    delta = F.col("rate") - F.col("baseline")
    return with_salience(rules).select(
        "*",
        subject.alias("subject"),
        literal_lookup(F.col("outcome"), {k: F.lit(v) for k, v in S.OUTCOME_PHRASES.items()}).alias("phrase"),
        delta.alias("delta"),
        ((F.abs(delta) >= 0.02) & (F.col("baseline") > 0)).alias("has_comparison"),
        (F.col("confidence") == "low").alias("dimmed"),
    )
