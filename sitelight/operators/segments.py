"""Size buckets, normalised delay and the segment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelight import schema as S
from sitelight.functions.columns import null_nan
from sitelight.functions.quantiles import exact_quantiles


def size_bucket(value: Column) -> Column:
    known = null_nan(value.cast("double"))
    return (
        F.when(known.isNull() | (known < S.SMALL_BELOW_USD), "small")
        .when(known < S.MEDIUM_BELOW_USD, "medium")
        .otherwise("large")
    )


def normalized_delay(delay: Column, duration: Column) -> Column:
    days = null_nan(duration.cast("double"))
    return F.when(days >= 0, null_nan(delay.cast("double")) / (days + 1))


def feature_medians(projects: DataFrame) -> DataFrame:
    """Median value and subcontractors per portfolio, over all rows."""
    return exact_quantiles(
        projects,
        ["portfolio_id"],
        {"_value": null_nan(F.col("contract_value_usd").cast("double")),
         "_subs": null_nan(F.col("subcontractor_count").cast("double"))},
        [0.5],
    ).select(
        "portfolio_id", F.col("_value")[0].alias("median_value"), F.col("_subs")[0].alias("median_subs")
    )


def cluster_features(projects: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Adds ``log_value``, ``subs``, ``type_key`` and ``region_key``: gaps take
    the portfolio median (0 without any value), missing categories the level
    "unknown". Categories stay as levels; their one-hot columns are implied."""
    medians = feature_medians(projects) if medians is None else medians
    value = F.coalesce(null_nan(F.col("contract_value_usd").cast("double")), "median_value", F.lit(0.0))
    subs = F.coalesce(null_nan(F.col("subcontractor_count").cast("double")), "median_subs", F.lit(0.0))
    return (
        projects.join(medians, "portfolio_id", "left")
        .withColumns(
            {
                "log_value": F.log1p(F.greatest(value, F.lit(0.0))),
                "subs": subs,
                "type_key": F.coalesce("project_type", F.lit("unknown")),
                "region_key": F.coalesce("region", F.lit("unknown")),
            }
        )
        .drop("median_value", "median_subs")
    )


def segments(projects: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """One row per project: bucket, normalised delay and (when given) cluster."""
    base = projects.select(
        "portfolio_id",
        "project_id",
        size_bucket(F.col("contract_value_usd")).alias("size_bucket"),
        normalized_delay(F.col("delay_days"), F.col("actual_duration_days")).alias("normalized_delay"),
    )
    if clusters is None:
        return base.withColumn("cluster_id", F.lit(None).cast("int"))
    return base.join(clusters.select("portfolio_id", "project_id", "cluster_id"),
                     ["portfolio_id", "project_id"], "left")
