"""From stored projects to the derived tables, and their refresh."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelight.functions.joins import released
from sitelight.operators import clustering, models, risk, rules, segments
from sitelight.session import materialize
from sitelight.sources.store import Store, bucket_of, slot_of
from sitelight.sources.tables import conform, integer_safe


class Analysis(NamedTuple):
    segments: DataFrame
    scores: DataFrame
    rules: DataFrame


def analyze(projects: DataFrame, clusters: DataFrame | None = None) -> Analysis:
    """Segments, scores and rules of every portfolio in ``projects``. Clusters
    are computed unless given. Every table reads the projects, some twice, so a
    plan that is costly to run is best written out before."""
    clusters = clustering.assign_clusters(projects) if clusters is None else clusters
    return Analysis(segments.segments(projects, clusters), risk.scores(projects), rules.rules(projects))


def analysis_counts(analysis: Analysis, portfolios: DataFrame) -> DataFrame:
    """Rows written per portfolio and derived table; 0 for empty portfolios."""
    out = portfolios.select("portfolio_id").distinct()
    for name, table in analysis._asdict().items():
        counted = table.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(counted, "portfolio_id", "left").fillna(0, [f"n_{name}"])
    return out


def stored_projects(spark: SparkSession, store: str, units: DataFrame | None = None) -> DataFrame:
    """The stored projects, of some units (portfolios, or buckets of them) if given."""
    rows = Store(spark, store).read("projects", units)
    if rows is None:
        rows = spark.createDataFrame([], "portfolio_id string, project_id string")
    return conform(rows)


def project_changes(store: Store, rows: DataFrame, units: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What a commit has to replace when ``rows`` become the projects of ``units``:
    these, and where their ids are found."""
    key = ["project_id", "portfolio_id", "home"]
    rows = rows.withColumn("bucket", bucket_of("project_id_external"))
    now = rows.join(units, units.columns, "left_semi").select("project_id", "portfolio_id", F.col("bucket").alias("home"))
    before = store.read("projects", units)
    old = now.limit(0) if before is None else before.select("project_id", "portfolio_id", F.col("bucket").alias("home"))
    moved = now.join(old, key, "left_anti").withColumn("added", F.lit(True)).unionByName(old.join(now, key, "left_anti").withColumn("added", F.lit(False)))
    moved = materialize(moved.withColumn("slot", slot_of("project_id")), "moved-ids")
    slots = moved.select("slot").distinct()
    known = store.read("places", slots)
    places = moved.where("added").select(*key, "slot")
    if known is not None:
        places = places.unionByName(known.select(*key, "slot").join(moved.where("not added"), key, "left_anti"))
    return {"projects": (rows, units), "places": (places, slots)}


def derived(projects: DataFrame, touched: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    return {name: (table, touched) for name, table in analyze(projects)._asdict().items()}


def refresh(spark: SparkSession, store: str, touched: DataFrame) -> None:
    """Recompute and replace the derived tables of the touched portfolios, the
    clusters included, in one version."""
    touched = touched.select("portfolio_id").distinct()
    with released():
        Store(spark, store).commit(uuid.uuid4().hex, derived(stored_projects(spark, store, touched), touched))


def store_projects(projects: DataFrame, store: str, touched: DataFrame | None = None, derive: bool = False) -> None:
    """Write cleaned projects, replacing their portfolios; with ``derive`` the
    derived tables change in the same version."""
    rows = materialize(integer_safe(conform(projects)), "projects")
    touched = (rows if touched is None else touched).select("portfolio_id").distinct()
    target = Store(rows.sparkSession, store)
    with released():
        changes = project_changes(target, rows, touched)
        if derive:
            changes |= derived(rows.join(touched, "portfolio_id", "left_semi"), touched)
        target.commit(uuid.uuid4().hex, changes)


def train(spark: SparkSession, store: str, touched: DataFrame, created_at=None) -> None:
    """Fit both models on the stored projects of some portfolios and replace their
    runs; a portfolio that can no longer be trained keeps none."""
    touched = touched.select("portfolio_id").distinct()
    with released():
        runs = models.model_runs(stored_projects(spark, store, touched), created_at)
        Store(spark, store).commit(uuid.uuid4().hex, {"model_runs": (runs, touched)})
