"""Cleaning of project records, many portfolios at once.

Raw rows carry ``portfolio_id``, ``_ord`` (a total order of the input) and the
required columns as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelight import schema as S
from sitelight.functions.columns import completed, kept, null_nan, to_iso_date, to_number
from sitelight.functions.joins import measured
from sitelight.functions.quantiles import exact_quantiles
from sitelight.session import materialize


def reject_null_keys(raw: DataFrame, key: str = "project_id") -> DataFrame:
    return raw.where(F.col(key).isNotNull())


def keep_first(raw: DataFrame, key: str = "project_id") -> DataFrame:
    """One row per key, the earliest in input order. The rank filter becomes a
    per-task limit before the shuffle, so a heavily repeated key sends one row
    per task."""
    order = W.partitionBy("portfolio_id", key).orderBy("_ord")
    return raw.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")


def coerce_types(raw: DataFrame) -> DataFrame:
    """Text to numbers and dates (unreadable values become null) and the
    derived duration in days."""
    typed = raw.withColumns(
        {
            **{c: to_number(F.col(c)) for c in S.NUMERIC_COLUMNS},
            **{c: to_iso_date(F.col(c)) for c in S.DATE_COLUMNS},
        }
    )
    return typed.withColumn("actual_duration_days", F.datediff("end_date", "start_date"))


def coercion_targets() -> dict[str, str]:
    return {**dict.fromkeys(S.NUMERIC_COLUMNS, "double"), **dict.fromkeys(S.DATE_COLUMNS, "date")}


def unread_columns():
    """Names of the columns of a raw row whose value is given but not readable."""
    def unread(name: str, kind: str):
        parsed = to_number(F.col(name)) if kind == "double" else to_iso_date(F.col(name))
        return F.col(name).isNotNull() & parsed.isNull()

    return kept(*[(unread(c, t), c) for c, t in coercion_targets().items()])


def coercion_report(raw: DataFrame) -> DataFrame:
    """Per portfolio and column: target type and how many values were given
    but could not be read. The derived duration is always listed. Takes raw
    rows, or typed rows that kept ``_unread``."""
    rows = raw if "_unread" in raw.columns else raw.withColumn("_unread", unread_columns())
    targets = coercion_targets()
    counted = rows.groupBy("portfolio_id").agg(
        *[F.count_if(F.array_contains("_unread", c)).alias(c) for c in targets]
    )
    lines = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit("string").alias("from"),
            F.lit(t).alias("to"), F.col(c).alias("n_invalid"),
        )
        for i, (c, t) in enumerate(targets.items())
    ]
    derived = F.struct(
        F.lit(len(targets)).alias("position"), F.lit("actual_duration_days").alias("column"),
        F.lit("derived").alias("from"), F.lit("int").alias("to"), F.lit(0).cast("bigint").alias("n_invalid"),
    )
    return counted.select("portfolio_id", F.inline(F.array(*lines, derived)))


def completed_medians(typed: DataFrame) -> DataFrame:
    """Exact median per portfolio and numeric column over finished rows."""
    return exact_quantiles(
        typed.where(completed()), ["portfolio_id"],
        {c: null_nan(F.col(c).cast("double")) for c in S.NUMERIC_COLUMNS}, [0.5],
    )


def _fillable(column: str):
    """Which rows a column may be filled on."""
    gap = null_nan(F.col(column).cast("double")).isNull()
    return gap & completed() if column in S.OUTCOME_COLUMNS else gap


def impute_medians(typed: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Fill gaps from the portfolio's finished work. Outcome counts are only
    filled on finished rows: running work has not earned a count yet. Without
    medians the rows are written out first, since the medians read them twice."""
    if medians is None:
        typed = materialize(typed, "typed-projects")
        medians = completed_medians(typed)
    values = medians.select(
        "portfolio_id", *[F.col(c)[0].alias(f"_median_{c}") for c in S.NUMERIC_COLUMNS]
    )
    filled = {
        c: F.when(_fillable(c), F.col(f"_median_{c}")).otherwise(null_nan(F.col(c).cast("double")))
        for c in S.NUMERIC_COLUMNS
    }
    return (
        typed.join(values, "portfolio_id", "left")
        .withColumns(filled)
        .drop(*[f"_median_{c}" for c in S.NUMERIC_COLUMNS])
    )


def imputation_report(typed: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Per portfolio and column: number of filled gaps and the value used;
    columns without a fill are not listed."""
    if medians is None:
        typed = materialize(typed.select("portfolio_id", "final_status", *S.NUMERIC_COLUMNS), "typed-projects")
        medians = completed_medians(typed)
    gaps = typed.groupBy("portfolio_id").agg(
        *[F.count_if(_fillable(c)).alias(f"_gaps_{c}") for c in S.NUMERIC_COLUMNS]
    )
    lines = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"),
            F.col(f"_gaps_{c}").alias("n_filled"), F.col(c)[0].alias("value"),
        )
        for i, c in enumerate(S.NUMERIC_COLUMNS)
    ]
    return (
        gaps.join(medians, "portfolio_id")
        .select("portfolio_id", F.inline(F.array(*lines)))
        .where("n_filled > 0 and value is not null")
    )


def flag_anomalies(projects: DataFrame) -> DataFrame:
    """Ordered list of threshold breaches; missing values breach nothing."""
    tests = [
        (null_nan(F.col("cost_overrun_pct").cast("double")) > S.HIGH_OVERRUN_PCT),
        (null_nan(F.col("delay_days").cast("double")) > S.HIGH_DELAY_DAYS),
        (null_nan(F.col("safety_incidents").cast("double")) >= S.HIGH_INCIDENTS),
        (null_nan(F.col("payment_disputes").cast("double")) >= S.HIGH_DISPUTES),
    ]
    names = [flag for flag, _ in S.FLAG_CATEGORIES]
    return projects.withColumn("anomaly_flags", kept(*zip(tests, names)))


def project_columns(projects: DataFrame) -> DataFrame:
    return projects.withColumnRenamed("project_id", "project_id_external").select(
        "portfolio_id", *S.OUTPUT_COLUMNS
    )


def clean(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw rows to cleaned projects and one summary row per portfolio.

    Order matters: duplicates leave before the medians are taken, flags are
    set after imputation. The rows shuffle once, for the duplicates; what
    remains is written out, so that medians, report and result read columns
    instead of repeating that shuffle. Medians come back as a small table.
    """
    unique = keep_first(reject_null_keys(raw))
    typed = materialize(coerce_types(unique.withColumn("_unread", unread_columns())), "typed-projects")
    medians = measured(completed_medians(typed))
    projects = project_columns(flag_anomalies(impute_medians(typed, medians)))
    return projects, summarize(raw, typed, projects, medians)


def summarize(raw: DataFrame, typed: DataFrame, projects: DataFrame, medians: DataFrame) -> DataFrame:
    """row_count, anomaly_count, rows_rejected, imputations[], coercions[]."""
    before = raw.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("_before"))
    after = projects.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.size("anomaly_flags") > 0).alias("anomaly_count"),
    )
    fills = _listed(imputation_report(typed, medians), "imputations", ["column", "n_filled", "value"])
    types = _listed(coercion_report(typed), "coercions", ["column", "from", "to", "n_invalid"])
    zero = F.lit(0).cast("bigint")
    return (
        before.join(after, "portfolio_id", "left")
        .join(fills, "portfolio_id", "left")
        .join(types, "portfolio_id", "left")
        .select(
            "portfolio_id",
            F.coalesce("row_count", zero).alias("row_count"),
            F.coalesce("anomaly_count", zero).alias("anomaly_count"),
            (F.col("_before") - F.coalesce("row_count", zero)).alias("rows_rejected"),
            F.coalesce("imputations", F.expr("cast(array() as array<struct<column:string,n_filled:bigint,value:double>>)")).alias("imputations"),
            "coercions",
        )
    )


def _listed(report: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """Report lines of a portfolio as one short array (one entry per column)."""
    entries = F.array_sort(F.collect_list(F.struct("position", *fields)))
    return report.groupBy("portfolio_id").agg(
        F.transform(entries, lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias(name)
    )


def validate_projects(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manually entered rows (text fields) split into typed valid rows and
    rejects with a list of error codes.

    Blank text counts as absent; the key is required, counts, value and
    duration must not be negative, the status must be a known one, dates ISO.
    """
    text = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in S.OUTPUT_COLUMNS
            if c in inputs.columns and c != "anomaly_flags"}
    rows = inputs.withColumns(text)
    numbers = S.NUMERIC_COLUMNS + ["actual_duration_days"]
    tests = [(F.col("project_id_external").isNull(), "missing:project_id_external")]
    for c in numbers:
        tests.append((F.col(c).isNotNull() & to_number(F.col(c)).isNull(), f"not_a_number:{c}"))
        if c in S.NON_NEGATIVE_COLUMNS:
            tests.append((to_number(F.col(c)) < 0, f"negative:{c}"))
    for c in S.DATE_COLUMNS:
        tests.append((F.col(c).isNotNull() & to_iso_date(F.col(c)).isNull(), f"bad_date:{c}"))
    tests.append((~F.col("final_status").isin(S.COMPLETED, S.IN_PROGRESS), "bad_status"))
    checked = rows.withColumn("errors", kept(*tests))
    typed = {c: to_number(F.col(c)) for c in numbers}
    typed.update({c: to_iso_date(F.col(c)) for c in S.DATE_COLUMNS})
    valid = checked.where(F.size("errors") == 0).drop("errors").withColumns(typed)
    return derive_duration(valid), checked.where(F.size("errors") > 0)


def derive_duration(rows: DataFrame) -> DataFrame:
    """Days between the dates when both are known, else the supplied value."""
    days = F.datediff("end_date", "start_date")
    return rows.withColumn(
        "actual_duration_days", F.coalesce(days, F.col("actual_duration_days").cast("int"))
    )
