"""Dispute models: a leaky one and one that only knows what a bid knows.

L2-penalised logistic regression (penalty 1/2 |w|^2, free intercept) for every
portfolio at once. Each Newton round reads the rows once: gradient and Hessian
are sums, grouped by (portfolio, type, region) with map-side combine, because
one-hot columns are constant within such a cell. Only these sums meet in the
small per-portfolio solve; rows never leave the distributed aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelight import schema as S
from sitelight.functions.columns import completed, holds, null_nan
from sitelight.functions.joins import measured
from sitelight.session import cut_lineage, materialize

NAIVE = "naive"
PRE_CONSTRUCTION = "pre_construction"
FEATURES = {
    NAIVE: [*S.BID_TIME_FEATURES, *S.LEAKY_FEATURES],
    PRE_CONSTRUCTION: S.BID_TIME_FEATURES,
}
CATEGORIES = ["project_type", "region"]
MAX_ROUNDS = 200
TOLERANCE = 1e-10


def numeric_features(features: list[str]) -> list[str]:
    return [f for f in features if f not in CATEGORIES]


def label() -> Column:
    """1 with at least one payment dispute; an absent count is 0."""
    return holds(null_nan(F.col("payment_disputes").cast("double")) >= 1).cast("double")


def training_rows(projects: DataFrame, features: list[str]) -> DataFrame:
    """Finished rows with every feature present, with their label."""
    numbers = numeric_features(features)
    return (
        projects.where(completed())
        .withColumn("label", label())
        .select("portfolio_id", "project_id", "label", *CATEGORIES,
                *[null_nan(F.col(c).cast("double")).alias(c) for c in numbers])
        .dropna(subset=features)
    )


def training_status(projects: DataFrame, features: list[str]) -> DataFrame:
    """Per portfolio: finished rows, usable rows, and whether a model can be
    fitted (``ok``), is trivial (``single_class``) or lacks rows
    (``insufficient``). Portfolios without finished rows are listed too."""
    present = F.lit(True)
    for c in features:
        known = F.col(c) if c in CATEGORIES else null_nan(F.col(c).cast("double"))
        present = present & known.isNotNull()
    usable_row = completed() & present
    return projects.groupBy("portfolio_id").agg(
        F.count_if(completed()).alias("n_completed"),
        F.count_if(usable_row).alias("n_usable"),
        F.count_if(usable_row & (label() == 1)).alias("n_positive"),
    ).withColumn(
        "status",
        F.when((F.col("n_completed") < S.MIN_TRAINING_ROWS) | (F.col("n_usable") < S.MIN_TRAINING_ROWS), "insufficient")
        .when((F.col("n_positive") == 0) | (F.col("n_positive") == F.col("n_usable")), "single_class")
        .otherwise("ok"),
    )


def trainable(projects: DataFrame) -> DataFrame:
    n = F.count_if(completed())
    return projects.groupBy("portfolio_id").agg(
        n.alias("n_completed"), (n >= S.MIN_TRAINING_ROWS).alias("trainable")
    )


def feature_names(rows: DataFrame, features: list[str]) -> DataFrame:
    """Encoded names per portfolio: numbers first, then every category level in
    name order."""
    numbers = numeric_features(features)
    levels = rows.select(
        "portfolio_id",
        F.inline(F.array(*[F.struct(F.lit(i).alias("block"), F.concat(F.lit(f"{c}_"), F.col(c)).alias("name"))
                           for i, c in enumerate(CATEGORIES)])),
    ).distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "name"))), lambda e: e["name"])
    return levels.groupBy("portfolio_id").agg(
        F.concat(F.array(*[F.lit(c) for c in numbers]), ordered).alias("features_used")
    )


def encoded(rows: DataFrame, features: list[str]) -> DataFrame:
    """One-hot encoded rows in long form: one entry per number and per category
    level taken; levels not taken are 0 by omission."""
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in numeric_features(features)]
    entries += [
        F.struct(F.concat(F.lit(f"{c}_"), F.col(c)).alias("feature"), F.lit(1.0).alias("value")) for c in CATEGORIES
    ]
    return rows.select("portfolio_id", "project_id", F.inline(F.array(*entries)))


# --- fitting -----------------------------------------------------------------------
_THETA = "intercept double, weights array<double>, types map<string,double>, regions map<string,double>"
_STATE = (
    f"portfolio_id string, {_THETA}, best_objective double, best_intercept double, best_weights array<double>, "
    "best_types map<string,double>, best_regions map<string,double>, settled boolean"
)


def _linear(numbers: list[str]) -> Column:
    total = F.col("intercept")
    for i, c in enumerate(numbers):
        total = total + F.col(f"z_{c}") * F.col("weights")[i]
    return (
        total
        + F.coalesce(F.element_at("types", F.col("project_type")), F.lit(0.0))
        + F.coalesce(F.element_at("regions", F.col("region")), F.lit(0.0))
    )


def _sums(rows: DataFrame, state: DataFrame, numbers: list[str]) -> DataFrame:
    """Loss, gradient and Hessian sums per (portfolio, type, region)."""
    score = rows.join(state.select("portfolio_id", "intercept", "weights", "types", "regions"), "portfolio_id")
    score = score.withColumn("eta", _linear(numbers))
    p = 1 / (1 + F.exp(-F.col("eta")))
    score = score.withColumns({"p": p}).withColumns(
        {
            "w": F.col("p") * (1 - F.col("p")),
            "r": F.col("label") - F.col("p"),
            # log(1 + e^eta) - y eta, without overflow
            "loss": F.greatest(F.col("eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))) - F.col("label") * F.col("eta"),
        }
    )
    x = [F.lit(1.0), *[F.col(f"z_{c}") for c in numbers]]
    gradient = F.array(*[F.sum(F.col("r") * a) for a in x])
    hessian = F.array(*[F.sum(F.col("w") * x[i] * x[j]) for i in range(len(x)) for j in range(i + 1)])
    return score.groupBy("portfolio_id", "project_type", "region").agg(
        F.sum("loss").alias("loss"), gradient.alias("g"), hessian.alias("h")
    )


def _newton_step(numbers: list[str]):
    """Per-portfolio solve on the summed cells (a handful of numbers)."""
    width = len(numbers) + 1

    def step(cells: pd.DataFrame) -> pd.DataFrame:
        first = cells.iloc[0]
        types = sorted(cells["project_type"].unique())
        regions = sorted(cells["region"].unique())
        size = width + len(types) + len(regions)
        gradient, hessian, loss = np.zeros(size), np.zeros((size, size)), 0.0
        lower = np.tril_indices(width)
        for cell in cells.itertuples():
            t = width + types.index(cell.project_type)
            r = width + len(types) + regions.index(cell.region)
            block = np.zeros((width, width))
            block[lower] = cell.h
            block = block + block.T - np.diag(np.diag(block))
            g = np.asarray(cell.g)
            loss += cell.loss
            gradient[:width] += g
            gradient[[t, r]] += g[0]
            hessian[:width, :width] += block
            for k in (t, r):
                hessian[:width, k] += block[:, 0]
                hessian[k, :width] += block[0]
            hessian[[t, r, t, r], [t, r, r, t]] += block[0, 0]
        penalty = np.concatenate([[0.0], 1.0 / np.asarray(first["scale"]) ** 2, np.ones(len(types) + len(regions))])

        def vector(intercept, weights, type_map, region_map):
            type_map, region_map = dict(type_map or {}), dict(region_map or {})
            return np.concatenate(
                [[intercept], weights, [type_map.get(t, 0.0) for t in types], [region_map.get(r, 0.0) for r in regions]]
            )

        theta = vector(first["intercept"], first["weights"], first["types"], first["regions"])
        objective = loss + 0.5 * float(penalty @ theta**2)
        had = first["best_objective"] is not None and not np.isnan(first["best_objective"])
        settled = False
        if had and objective > first["best_objective"] + 1e-9 * abs(first["best_objective"]) + 1e-12:
            # Overshot: go half way back to the best point so far.
            best = vector(first["best_intercept"], first["best_weights"], first["best_types"], first["best_regions"])
            best_objective, following = first["best_objective"], (theta + best) / 2
            settled = bool(np.max(np.abs(theta - best)) < 1e-12)
        else:
            slope = gradient - penalty * theta
            move = np.linalg.solve(hessian + np.diag(penalty) + 1e-12 * np.eye(size), slope)
            best, best_objective, following = theta, objective, theta + move
            settled = bool(slope @ move <= TOLERANCE * max(1.0, objective))

        def parts(v):
            return {
                "intercept": float(v[0]),
                "weights": [float(a) for a in v[1:width]],
                "types": dict(zip(types, map(float, v[width:width + len(types)]))),
                "regions": dict(zip(regions, map(float, v[width + len(types):]))),
            }

        row = {"portfolio_id": first["portfolio_id"], **parts(following), "best_objective": float(best_objective),
               **{f"best_{k}": v for k, v in parts(best).items()}, "settled": settled}
        return pd.DataFrame([row])

    return step


def fit(projects: DataFrame, model_type: str) -> DataFrame:
    """One report row per portfolio: model_type, status, accuracy on the
    training rows, features_used, feature_importances (absolute weight per
    encoded feature, empty for a single class), n_training_samples."""
    features = FEATURES[model_type]
    numbers = numeric_features(features)
    projects = projects.withColumn("portfolio_id", F.col("portfolio_id").cast("string"))
    status = measured(training_status(projects, features))
    rows = materialize(training_rows(projects, features), "training-rows")
    names = measured(feature_names(rows, features))

    trained = status.where("status = 'ok'").select("portfolio_id")
    scales = rows.groupBy("portfolio_id").agg(
        F.array(*[F.avg(c) for c in numbers]).alias("center"),
        F.array(*[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0) for c in numbers]).alias("scale"),
    )
    scales = measured(scales.join(trained, "portfolio_id"))
    scaled = rows.join(scales, "portfolio_id").select(
        "portfolio_id", "label", *CATEGORIES,
        *[((F.col(c) - F.col("center")[i]) / F.col("scale")[i]).alias(f"z_{c}") for i, c in enumerate(numbers)],
    )
    empty = "cast(map() as map<string,double>)"
    state = scales.selectExpr(
        "portfolio_id", "0D as intercept", f"array_repeat(0D, {len(numbers)}) as weights",
        f"{empty} as types", f"{empty} as regions", "cast(null as double) as best_objective",
        "0D as best_intercept", f"array_repeat(0D, {len(numbers)}) as best_weights",
        f"{empty} as best_types", f"{empty} as best_regions", "false as settled",
    )
    state = cut_lineage(state)
    finished = None
    for _ in range(MAX_ROUNDS):
        if state.isEmpty():
            break
        sent = measured(state)
        sums = _sums(scaled, sent, numbers)
        solved = (
            sums.join(state, "portfolio_id").join(scales.select("portfolio_id", "scale"), "portfolio_id")
            .groupBy("portfolio_id").applyInPandas(_newton_step(numbers), _STATE)
        )
        solved = cut_lineage(solved)
        sent.unpersist()
        done = solved.where("settled")
        finished = done if finished is None else finished.unionByName(done)
        state = solved.where("not settled")
    weights = state if finished is None else finished.unionByName(state)
    weights = measured(
        weights.select("portfolio_id", *[F.col(f"best_{c}").alias(c) for c in ["intercept", "weights", "types", "regions"]])
    )

    hits = (
        scaled.join(weights, "portfolio_id")
        .withColumn("hit", ((_linear(numbers) > 0).cast("double") == F.col("label")).cast("double"))
        .groupBy("portfolio_id").agg(F.avg("hit").alias("_accuracy"))
    )
    prefixed = lambda m, c: F.transform_keys(m, lambda k, _: F.concat(F.lit(f"{c}_"), k))
    importances = weights.join(scales, "portfolio_id").select(
        "portfolio_id",
        F.transform_values(
            F.map_concat(
                F.map_from_arrays(
                    F.array(*[F.lit(c) for c in numbers]), F.zip_with("weights", "scale", lambda w, s: w / s)
                ),
                prefixed("types", "project_type"), prefixed("regions", "region"),
            ),
            lambda _, v: F.abs(v),
        ).alias("_importances"),
    )
    ok = F.col("status") == "ok"
    single = F.col("status") == "single_class"
    return (
        status.join(hits, "portfolio_id", "left").join(importances, "portfolio_id", "left").join(names, "portfolio_id", "left")
        .select(
            "portfolio_id",
            F.lit(model_type).alias("model_type"),
            "status",
            F.when(ok, F.col("_accuracy")).when(single, 1.0).alias("accuracy"),
            F.when(ok | single, F.col("features_used")).alias("features_used"),
            F.when(ok, F.col("_importances")).when(single, F.expr(empty)).alias("feature_importances"),
            F.col("n_usable").alias("n_training_samples"),
            "n_completed",
        )
    )


def model_runs(projects: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Both models of every trainable portfolio, ready to replace its runs."""
    columns = {c for features in FEATURES.values() for c in features}
    columns |= {"portfolio_id", "project_id", "final_status", "payment_disputes", *CATEGORIES}
    # each model reads the projects twice: they are written once, as narrow as both allow
    projects = materialize(projects.select(*sorted(columns)), "model-source")
    both = fit(projects, NAIVE).unionByName(fit(projects, PRE_CONSTRUCTION))
    return both.where("status <> 'insufficient'").withColumn(
        "created_at", F.current_timestamp() if created_at is None else created_at
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    fields = [c for c in runs.columns if c not in ("portfolio_id", "model_type")]
    order = W.partitionBy("portfolio_id", "model_type").orderBy(F.desc("created_at"))
    return runs.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(
        "portfolio_id", "model_type", *fields
    )


def importance_share(runs: DataFrame, top: int = 6) -> DataFrame:
    """Share of each feature in the total importance, leaky ones marked."""
    long = runs.select(
        "portfolio_id", "model_type", F.explode("feature_importances").alias("feature", "_value")
    ).withColumn("_value", F.greatest(F.lit(0.0), null_nan(F.col("_value"))))
    by_run = W.partitionBy("portfolio_id", "model_type")
    ranked = by_run.orderBy(F.desc("share"), "feature")
    return (
        long.withColumn("_total", F.sum("_value").over(by_run)).where("_total > 0")
        .withColumns({"share": F.col("_value") / F.col("_total"), "leaky": F.col("feature").isin(S.LEAKY_FEATURES)})
        .withColumn("position", F.row_number().over(ranked)).where(F.col("position") <= top)
        .drop("_value", "_total")
    )


def leakage_gap(runs: DataFrame) -> DataFrame:
    """Accuracy points the leaky model gains over the honest one."""
    accuracy = lambda kind: F.max(F.when(F.col("model_type") == kind, F.col("accuracy")))
    return runs.groupBy("portfolio_id").agg(
        accuracy(NAIVE).alias("naive_accuracy"),
        accuracy(PRE_CONSTRUCTION).alias("pre_construction_accuracy"),
        ((accuracy(NAIVE) - accuracy(PRE_CONSTRUCTION)) * 100).alias("gap_points"),
    )
