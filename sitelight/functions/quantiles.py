"""Exact quantiles of huge groups in two scans.

The built-in exact ``percentile`` keeps every distinct value of a group in one
buffer, which a hot group outgrows. Here a sketch first brackets each wanted
rank (scan 1, small mergeable state); then only the values inside the bracket
are counted by value, everything below collapses to one counter (scan 2, with
map-side combine), and the order statistic is read off the cumulative counts.
The bracket covers about ``8 / accuracy`` of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelight.functions.joins import measured


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    probabilities: list[float],
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per key: ``<name>`` = array of quantiles (linear interpolation,
    in the order of ``probabilities``; null without values) and ``<name>_n`` =
    non-null count. The result derives from a cached table of known size, so
    joining it does not shuffle the facts while it is small.
    """
    base = df.select(*keys, *[e.cast("double").alias(n) for n, e in values.items()])
    margin = 4.0 / accuracy
    probes = []
    for p in probabilities:
        probes += [max(0.0, p - margin), min(1.0, p + margin)]

    sketched = base.groupBy(*keys).agg(
        *[F.count(n).alias(f"{n}_n") for n in values],
        *[F.percentile_approx(n, probes, accuracy).alias(f"{n}_probe") for n in values],
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"),
                F.lit(i).alias("slot"),
                F.col(f"{n}_n").alias("n"),
                (F.lit(p) * (F.col(f"{n}_n") - 1)).alias("rank"),
                F.col(f"{n}_probe")[2 * i].alias("low"),
                F.col(f"{n}_probe")[2 * i + 1].alias("high"),
            )
            for n in values
            for i, p in enumerate(probabilities)
        ]
    )
    brackets = measured(sketched.select(*keys, F.inline(wanted)).where("n > 0"))
    found = measured(_resolve(base, keys, list(values), brackets))

    missed = found.where("low_value is null or high_value is null or below > floor(rank)")
    if not missed.isEmpty():
        # A sketch outside its error bound: reopen those brackets completely.
        redo = missed.select(
            *keys, "name", "slot", "n", "rank",
            F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
        )
        again = _resolve(base, keys, list(values), measured(redo))
        found = found.join(missed.select(*keys, "name", "slot"), [*keys, "name", "slot"], "left_anti")
        found = measured(found.unionByName(again))

    # Equal ends need no interpolation, which would turn an infinity into NaN.
    between = F.col("low_value") + (F.col("high_value") - F.col("low_value")) * (F.col("rank") - F.floor("rank"))
    quantile = F.when(F.col("low_value") == F.col("high_value"), F.col("low_value")).otherwise(between)
    per_name = [
        F.when(
            F.max(F.when(F.col("name") == n, 1)) == 1,
            F.array(
                *[
                    F.max(F.when((F.col("name") == n) & (F.col("slot") == i), quantile))
                    for i in range(len(probabilities))
                ]
            ),
        ).alias(n)
        for n in values
    ]
    counts = [
        F.coalesce(F.max(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(f"{n}_n")
        for n in values
    ]
    return found.groupBy(*keys).agg(*per_name, *counts)


def _resolve(base: DataFrame, keys: list[str], names: list[str], brackets: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])
    long = base.select(*keys, F.inline(cells)).where("v is not null")
    inside = F.when(F.col("v") >= F.col("low"), F.col("v"))
    counted = (
        long.join(brackets, [*keys, "name"])
        .where("v <= high")
        .groupBy(*keys, "name", "slot", "n", "rank", inside.alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    running = F.sum("c").over(
        W.partitionBy(*keys, "name", "slot")
        .orderBy(F.col("v").asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        counted.withColumn("upto", running)
        .groupBy(*keys, "name", "slot", "n", "rank")
        .agg(
            F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"),
            F.min(F.when(F.col("upto") > F.floor("rank"), F.col("v"))).alias("low_value"),
            F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("v"))).alias("high_value"),
        )
    )
