"""Batches of project changes: upserts, deletes and cascades.

A mutation batch has ``seq`` (total order), ``op`` (upsert | delete),
``portfolio_id``, ``project_id`` (optional for upserts) and the editable
columns. Ids and external ids are looked up in the table as it is at the start
of the batch; within the batch later changes win.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelight import schema as S
from sitelight.functions.joins import measured
from sitelight.operators.cleaning import derive_duration


class Applied(NamedTuple):
    projects: DataFrame  # the table after the batch
    rejected: DataFrame  # seq, op, portfolio_id, project_id, project_id_external, error
    touched: DataFrame  # portfolio_id of every portfolio with a change
    deleted: DataFrame  # portfolio_id, project_id


def new_project_id(portfolio_id: Column, external_id: Column) -> Column:
    """Id of an inserted row, derived from its key: a repeated task or batch
    yields the same id."""
    digest = F.md5(F.concat_ws("\u0001", portfolio_id.cast("string"), external_id))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def bad_input() -> Column:
    """The first reason, if any, why a typed row may not be stored."""
    checks = [F.when(F.col(c) < 0, f"negative:{c}") for c in S.NON_NEGATIVE_COLUMNS]
    known = F.col("final_status").isNull() | F.col("final_status").isin(S.COMPLETED, S.IN_PROGRESS)
    return F.coalesce(*checks, F.when(~known, "bad_status"))


def apply_mutations(projects: DataFrame, mutations: DataFrame, portfolios: DataFrame | None = None) -> Applied:
    """Resolve, validate and merge one batch.

    A row with a negative count, value or duration or an unknown status is
    rejected, whatever it addresses.
    By id: the row must exist, in the named portfolio. Without id: the row
    with the external id is updated, else a row is inserted. An update replaces
    every editable column and keeps the row's source, an insert is manual.
    After a delete the id is gone, so later changes by id are rejected, while a
    later change by external id inserts a new row.
    """
    projects = projects.withColumn("project_id", F.col("project_id").cast("string"))
    known = projects.select(
        F.col("portfolio_id").alias("_portfolio"), F.col("project_id").alias("_id"),
        F.col("project_id_external").alias("_external"), F.col("source").alias("_source"),
    )
    rows = measured(mutations)
    if portfolios is not None:
        listed = portfolios.select("portfolio_id").distinct().withColumn("_listed", F.lit(True))
        rows = rows.join(listed, "portfolio_id", "left")
    else:
        rows = rows.withColumn("_listed", F.lit(True))
    # A batch names few rows of a large table: reduce the table to those first,
    # which needs no shuffle of it while the named keys are small.
    ids = measured(rows.select(F.col("project_id").alias("_id")).where("_id is not null").distinct())
    names = measured(
        rows.where("project_id is null")
        .select(F.col("portfolio_id").alias("_portfolio"), F.col("project_id_external").alias("_external")).distinct()
    )
    with_id = rows.where("project_id is not null").join(
        known.join(ids, "_id", "left_semi"), F.col("project_id") == F.col("_id"), "left"
    )
    # of several rows that bear an external id, the one with the smallest id changes
    one = known.join(names, ["_portfolio", "_external"], "left_semi").groupBy("_portfolio", "_external")
    one = one.agg(F.min(F.struct("_id", "_source")).alias("_one")).select("_portfolio", F.col("_one._id").alias("_id"), "_external", F.col("_one._source").alias("_source"))
    without_id = rows.where("project_id is null").join(
        one,
        (F.col("portfolio_id") == F.col("_portfolio")) & (F.col("project_id_external") == F.col("_external")),
        "left",
    )
    resolved = measured(with_id.unionByName(without_id))

    # First delete per existing row, counted where it may take effect.
    deletes = resolved.where("op = 'delete' and project_id is not null and _portfolio = portfolio_id and _listed")
    first_delete = deletes.groupBy(F.col("_id").alias("_gone")).agg(F.min("seq").alias("_gone_at"))
    resolved = resolved.join(first_delete, F.col("_id") == F.col("_gone"), "left")

    by_id = F.col("project_id").isNotNull()
    after = F.coalesce(F.col("seq") > F.col("_gone_at"), F.lit(False))
    error = (
        F.when((F.col("op") == "upsert") & bad_input().isNotNull(), bad_input())
        .when(F.col("_listed").isNull(), "portfolio not found")
        .when(F.col("project_id_external").isNull() & (F.col("op") == "upsert"), "missing external id")
        .when((by_id & F.col("_id").isNull()) | (~by_id & (F.col("op") == "delete")), "project not found")
        .when(by_id & (F.col("_portfolio") != F.col("portfolio_id")), "project belongs to a different portfolio")
        .when(by_id & after, "project not found")
    )
    checked = resolved.withColumn("error", error)
    rejected = checked.where("error is not null").select(
        "seq", "op", "portfolio_id", "project_id", "project_id_external", "error"
    )

    fresh = F.col("_id").isNull() | F.col("_gone_at").isNotNull()
    valid = checked.where("error is null").withColumn(
        "_target",
        F.when(F.col("_id").isNull() | after, new_project_id(F.col("portfolio_id"), F.col("project_id_external")))
        .otherwise(F.col("_id")),
    )
    deleted = valid.where("op = 'delete'").select("portfolio_id", F.col("_target").alias("project_id")).distinct()
    # Changes to a row that the batch deletes later have no lasting effect.
    lasting = valid.where((F.col("op") == "upsert") & (~fresh | F.col("_id").isNull() | after))
    newest = W.partitionBy("_target").orderBy(F.desc("seq"))
    latest = lasting.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    written = derive_duration(latest).select(
        "portfolio_id",
        F.col("_target").alias("project_id"),
        *S.OUTPUT_COLUMNS,
        F.when(F.col("_target") == F.col("_id"), F.coalesce("_source", F.lit(S.SOURCE_CSV)))
        .otherwise(S.SOURCE_MANUAL).alias("source"),
    )
    changed = measured(written.select("project_id").unionByName(deleted.select("project_id")))
    untouched = projects.select(*written.columns).join(changed, "project_id", "left_anti")
    merged = untouched.unionByName(written.select(*[F.col(f.name).cast(f.dataType) for f in untouched.select(*written.columns).schema]))
    touched = written.select("portfolio_id").unionByName(deleted.select("portfolio_id")).distinct()
    return Applied(merged, rejected, touched, deleted)


def delete_projects(projects: DataFrame, requests: DataFrame) -> Applied:
    """Deletes by (portfolio_id, project_id) only; ``seq`` orders the batch."""
    empty = {c: F.lit(None).cast(S.PROJECT_TYPES[c]) for c in S.OUTPUT_COLUMNS if c not in requests.columns}
    return apply_mutations(projects, requests.withColumn("op", F.lit("delete")).withColumns(empty))


def cascade(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose parent was not removed."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti")
