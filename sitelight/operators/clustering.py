"""K-means cluster ids for many portfolios in one loop.

Starts are spread out: each is drawn from a bounded sample of the portfolio with
a chance that grows with its squared distance to those before it. A cluster that
loses its rows takes over the row that is farthest from its centre. All portfolios and restarts move together. One-hot columns are never built: a
centroid's one-hot coordinates are the category shares of its cluster, so for
rows of one (type, region) they add a constant to the squared distance. Each
round sends a small table of centres and constants to the rows, picks the
nearest in generated code, and sums by cluster, type and region with map-side
combine; only those sums meet per portfolio to form the next centres.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelight.functions.joins import measured
from sitelight.operators.segments import cluster_features
from sitelight.session import materialize

# What clusters are made of.
SOURCE = ["portfolio_id", "project_id", "contract_value_usd", "subcontractor_count", "project_type", "region"]
MIN_ROWS = 4
# Squared movement, relative to the mean variance of the numbers, below which a
# centroid counts as settled.
TOLERANCE = 1e-4
# Rows of a portfolio, by hash, among which the starts are drawn.
SEED_ROWS = 256


def effective_k(n: Column, k: int) -> Column:
    """max(2, min(k, n // 3)); portfolios under four rows form one group."""
    return F.greatest(F.lit(2), F.least(F.lit(k), F.floor(n / 3))).cast("int")


def assign_clusters(projects: DataFrame, k: int = 3, restarts: int = 10, max_rounds: int = 300) -> DataFrame:
    """portfolio_id, project_id, cluster_id. Ids are numbered by ascending
    centroid (log value, then subcontractors), so they are reproducible."""
    return fit_clusters(projects, k, restarts, max_rounds)[0]


def fit_clusters(projects: DataFrame, k: int = 3, restarts: int = 10, max_rounds: int = 300) -> tuple[DataFrame, DataFrame]:
    """The cluster ids; and per portfolio of ``MIN_ROWS`` rows or more the restart
    that won, the rounds it took, whether it settled within ``max_rounds``, and
    its inertia."""
    rows, sizes = feature_rows(projects)
    state = settle(rows, sizes, k, restarts, max_rounds)
    costs = inertia(rows, state, k)
    best = costs.groupBy("portfolio_id").agg(
        F.min(F.struct(F.round("inertia", 6).alias("inertia"), "restart")).alias("best")
    ).select("portfolio_id", "best.*")
    chosen = measured(state.join(best, ["portfolio_id", "restart"]).withColumns(_order(k)))
    labels = nearest_centres(rows, chosen.drop("inertia"), k).select(
        "portfolio_id", "project_id",
        F.coalesce(*[F.when(F.col("cluster") == j, F.col(f"order_{j}")) for j in range(k)]).alias("cluster_id"),
    )
    small = rows.join(sizes.where(F.col("n") < MIN_ROWS).select("portfolio_id"), "portfolio_id", "left_semi")
    report = chosen.groupBy("portfolio_id", "restart", "inertia").agg(
        F.max("rounds").alias("rounds"), F.bool_and(~F.col("moving")).alias("converged")
    )
    return labels.unionByName(small.select("portfolio_id", "project_id", F.lit(0).alias("cluster_id"))), report


def misplaced(projects: DataFrame, clusters: DataFrame, margin: float = 0.01) -> DataFrame:
    """portfolio_id, rows, clusters, and how many rows are nearer to another
    cluster's mean than to their own by more than ``margin`` of the distance."""
    rows, _ = feature_rows(projects)
    # sizes, shares and distances each read the rows
    rows = materialize(rows.join(clusters, ["portfolio_id", "project_id"]), "clustered-rows")
    keys = ["portfolio_id", "cluster_id"]
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("log_value").alias("value"), F.avg("subs").alias("count"))
    means = size
    for c in ("type_key", "region_key"):
        shares = rows.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("m")).join(size.select(*keys, "n"), keys)
        shares = shares.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(c, F.col("m") / F.col("n")))).alias(c))
        means = means.join(shares.withColumn(f"{c}_own", F.aggregate(F.map_values(c), F.lit(0.0), lambda t, x: t + x * x)), keys)
    mean = F.struct("cluster_id", "value", "count", F.col("type_key").alias("types"), F.col("region_key").alias("regions"), (F.col("type_key_own") + F.col("region_key_own")).alias("own"))
    met = rows.join(means.groupBy("portfolio_id").agg(F.collect_list(mean).alias("means")), "portfolio_id")

    def squared(m: Column) -> Column:
        share = lambda shares, key: F.coalesce(F.element_at(shares, F.col(key)), F.lit(0.0))
        value, subs = F.col("log_value") - m["value"], F.col("subs") - m["count"]
        return value * value + subs * subs + 2 + m["own"] - 2 * (share(m["types"], "type_key") + share(m["regions"], "region_key"))

    best = F.array_min(F.transform("means", squared))
    own = squared(F.filter("means", lambda m: m["cluster_id"] == F.col("cluster_id"))[0])
    return met.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster_id").alias("n_clusters"), F.count_if(own > best * (1 + margin) + 1e-9).alias("n_misplaced"),
    )


def feature_rows(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature columns written once, and size and spread per portfolio."""
    source = materialize(projects.select(*SOURCE), "cluster-source")
    rows = materialize(
        cluster_features(source).select(
            "portfolio_id", "project_id", "log_value", "subs", "type_key", "region_key"
        ),
        "cluster-features",
    )
    sizes = rows.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("n"), ((F.var_pop("log_value") + F.var_pop("subs")) / 2).alias("spread")
    )
    return rows, measured(sizes)


def settle(rows: DataFrame, sizes: DataFrame, k: int, restarts: int, max_rounds: int) -> DataFrame:
    """Centres after the last move: one row per portfolio, restart, type and
    region with ``value_j``, ``count_j`` and ``constant_j`` of every cluster j,
    the ``rounds`` that were made, and whether they still move."""
    portfolios = measured(sizes.where(F.col("n") >= MIN_ROWS).withColumn("k", effective_k(F.col("n"), k)))
    blank = rows.select("portfolio_id", "type_key", "region_key").distinct().join(portfolios, "portfolio_id").select(
        "portfolio_id", "type_key", "region_key", "spread",
        F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"),
        *[F.lit(None).cast("double").alias(c) for c in _centre_columns(k)],
        F.lit(True).alias("moving"), F.lit(-1).alias("rounds"),
    )
    state = materialize(_advance(_starts(rows, portfolios, restarts), blank, k), "cluster-state")
    for _ in range(max_rounds):
        moving = state.where("moving")
        if moving.isEmpty():
            break
        sent = measured(moving)
        sums = nearest_centres(rows, sent, k).groupBy(
            "portfolio_id", "restart", "cluster", "type_key", "region_key"
        ).agg(
            F.count(F.lit(1)).alias("n"), F.sum("log_value").alias("v"), F.sum("subs").alias("s"),
            # scalars, so that the sums stay a hash aggregation
            F.max("distance").alias("far_distance"), F.max_by("log_value", "distance").alias("far_v"), F.max_by("subs", "distance").alias("far_s"),
        )
        state = materialize(_advance(sums, sent, k).unionByName(state.where("not moving")), "cluster-state")
        sent.unpersist()
    return state


def _centre_columns(k: int) -> list[str]:
    return [f"{name}_{j}" for j in range(k) for name in ("value", "count", "constant")]


def _starts(rows: DataFrame, portfolios: DataFrame, restarts: int) -> DataFrame:
    """``restarts`` sets of k rows as clusters of one row each, drawn from a
    bounded sample per portfolio (limited in each task before the shuffle)."""
    order = W.partitionBy("portfolio_id").orderBy(F.xxhash64("project_id", F.lit(42)), "project_id")
    sample = (
        rows.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= SEED_ROWS)
        .join(portfolios.select("portfolio_id", "k"), "portfolio_id")
        .select("portfolio_id", "k", "slot", "type_key", "region_key", "log_value", "subs")
    )

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("slot").reset_index(drop=True)
        numbers, kinds = part[["log_value", "subs"]].to_numpy(float), part[["type_key", "region_key"]].to_numpy(object)
        chosen = []
        for restart in range(restarts):
            random = np.random.default_rng(restart)
            near = np.ones(len(part))
            for cluster in range(int(part["k"].iloc[0])):
                chance = near if near.sum() > 0 else np.ones(len(part))
                row = int(random.choice(len(part), p=chance / chance.sum()))
                distance = ((numbers - numbers[row]) ** 2).sum(axis=1) + 2.0 * (kinds != kinds[row]).sum(axis=1)
                near = np.minimum(near, distance) if cluster else distance
                chosen.append((row, restart, cluster))
        out = part.loc[[c[0] for c in chosen], ["portfolio_id", "type_key", "region_key"]].reset_index(drop=True)
        at = [c[0] for c in chosen]
        return out.assign(restart=[c[1] for c in chosen], cluster=[c[2] for c in chosen], n=1, v=numbers[at, 0], s=numbers[at, 1], far_distance=0.0, far_v=0.0, far_s=0.0)

    return sample.groupBy("portfolio_id").applyInPandas(
        draw, f"portfolio_id {dict(rows.dtypes)['portfolio_id']}, type_key string, region_key string, restart int, cluster int, n long, v double, s double, far_distance double, far_v double, far_s double"
    )


def nearest_centres(rows: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """Rows once per restart with the closest cluster and its squared distance."""
    def squared(j: int) -> Column:
        value, subs = F.col("log_value") - F.col(f"value_{j}"), F.col("subs") - F.col(f"count_{j}")
        return F.coalesce(value * value + subs * subs + F.col(f"constant_{j}"), F.lit(float("inf")))

    near = rows.join(centres, ["portfolio_id", "type_key", "region_key"])
    near = near.withColumns({f"_d{j}": squared(j) for j in range(k)})
    near = near.withColumn("distance", F.least(*[F.col(f"_d{j}") for j in range(k)]) if k > 1 else F.col("_d0"))
    cluster = F.coalesce(*[F.when(F.col(f"_d{j}") == F.col("distance"), F.lit(j)) for j in range(k)])
    kept = [c for c in centres.columns if c.startswith("order_")]
    return near.select(*rows.columns, "restart", cluster.alias("cluster"), "distance", *kept)


def _advance(sums: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """Next centres from the sums of the last assignment."""
    keyed = sums.toDF(*["_key" if c == "portfolio_id" else c for c in sums.columns])
    both = keyed.groupBy("_key").cogroup(state.groupBy("portfolio_id"))
    return both.applyInPandas(_next_centres(k), state.schema)


def _next_centres(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Per portfolio: means and category shares of each cluster. The input has
    one row per restart, cluster, type and region, with its farthest row. A
    cluster without rows moves to the farthest row that no other one took."""

    def advance(sums: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if sums.empty or state.empty:
            return state
        state = state.reset_index(drop=True)
        restarts = np.unique(state["restart"])
        run, slot = np.searchsorted(restarts, sums["restart"]), sums["cluster"].to_numpy()
        mine = np.searchsorted(restarts, state["restart"])
        n, v, s = (np.zeros((len(restarts), k)) for _ in range(3))
        for total, name in ((n, "n"), (v, "v"), (s, "s")):
            np.add.at(total, (run, slot), sums[name].to_numpy(float))
        levels, shares = {}, {}
        for c in ("type_key", "region_key"):
            levels[c] = pd.Index(pd.unique(pd.concat([state[c], sums[c]])))
            shares[c] = np.zeros((len(restarts), k, len(levels[c])))
            np.add.at(shares[c], (run, slot, levels[c].get_indexer(sums[c])), sums["n"].to_numpy(float))
        # clusters without rows
        wanted = int((~state[[f"value_{j}" for j in range(k)]].isna()).any().sum()) or k
        far = sums.assign(run=run).sort_values(["run", "far_distance"], ascending=[True, False])
        for r in np.flatnonzero((n[:, :wanted] == 0).any(axis=1)):
            rows = far[(far["run"] == r) & (far["far_distance"] > 0)].itertuples()
            for j, row in zip(np.flatnonzero(n[r, :wanted] == 0), rows):
                n[r, j], v[r, j], s[r, j] = 1, row.far_v, row.far_s
                for c in shares:
                    shares[c][r, j, levels[c].get_loc(getattr(row, c))] = 1
        there = n > 0
        size = np.where(there, n, 1)
        own = sum((share**2).sum(axis=2) for share in shares.values()) / size**2
        moved = np.zeros(len(state))
        for j in range(k):
            shared = sum(shares[c][mine, j, levels[c].get_indexer(state[c])] for c in shares) / size[mine, j]
            fresh = {"value": (v / size)[mine, j], "count": (s / size)[mine, j], "constant": 2 + own[mine, j] - 2 * shared}
            for name, value in fresh.items():
                before = state[f"{name}_{j}"].to_numpy(float)
                # the first centres have nothing to move from: they always move
                step = np.where(np.isnan(before), np.inf, (value - before) ** 2)
                moved += np.where(there[mine, j], step * (0.25 if name == "constant" else 1.0), 0.0)
                state[f"{name}_{j}"] = np.where(there[mine, j], value, before)
        state["moving"] = moved > np.maximum(state["spread"], 1e-12) * TOLERANCE
        state["moving"] = state.groupby("restart")["moving"].transform("any")
        state["rounds"] += 1
        return state

    return advance


def inertia(rows: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """Sum of squared distances per portfolio and restart."""
    return nearest_centres(rows, measured(centres), k).groupBy("portfolio_id", "restart").agg(
        F.sum("distance").alias("inertia")
    )


def _order(k: int) -> dict[str, Column]:
    """Number of each cluster by ascending centre; equal centres keep their order."""
    def before(i: int, j: int) -> Column:
        a, b = F.struct(f"value_{i}", f"count_{i}"), F.struct(f"value_{j}", f"count_{j}")
        earlier = (a < b) | ((a == b) & F.lit(i < j))
        return (F.col(f"value_{i}").isNotNull() & earlier).cast("int")

    return {
        f"order_{j}": sum((before(i, j) for i in range(k) if i != j), F.lit(0)) for j in range(k)
    }
