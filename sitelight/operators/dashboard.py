"""The questions a portfolio dashboard asks of projects, scores and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelight import schema as S
from sitelight.functions.columns import finite, literal_lookup, null_nan
from sitelight.functions.quantiles import exact_quantiles

# Limits above which a table cell is highlighted.
HIGHLIGHT_ABOVE = {
    "delay_days": 30,
    "cost_overrun_pct": 25,
    "safety_incidents": 0,
    "payment_disputes": 0,
}


def kpis(projects: DataFrame, scores: DataFrame) -> DataFrame:
    """Totals, counts and means per portfolio; scores aggregate on their own
    side first, so two small tables are joined."""
    facts = projects.groupBy("portfolio_id").agg(
        F.coalesce(F.sum(null_nan(F.col("contract_value_usd"))), F.lit(0.0)).alias("total_contract_usd"),
        F.count(F.lit(1)).alias("n_projects"),
        F.count_if(F.col("final_status") == S.COMPLETED).alias("n_completed"),
        F.count_if(F.col("final_status") == S.IN_PROGRESS).alias("n_in_progress"),
        F.avg(null_nan(F.col("delay_days"))).alias("mean_delay_days"),
    )
    risk = scores.groupBy("portfolio_id").agg(
        F.avg("score").alias("mean_risk"), F.count("score").alias("n_scored")
    )
    return facts.join(risk, "portfolio_id", "left").fillna(0, ["n_scored"])


def mean_by_type(projects: DataFrame, measure: str) -> DataFrame:
    value = null_nan(F.col(measure).cast("double"))
    return (
        projects.where((F.col("project_type") != "") & value.isNotNull())
        .groupBy("portfolio_id", "project_type")
        .agg(F.round(F.avg(value), 2).alias(f"mean_{measure}"))
        .orderBy("portfolio_id", "project_type")
    )


def count_by_region(projects: DataFrame) -> DataFrame:
    return (
        projects.where(F.col("region") != "")
        .groupBy("portfolio_id", "region")
        .agg(F.count(F.lit(1)).alias("n_projects"))
        .orderBy("portfolio_id", F.desc("n_projects"), "region")
    )


def riskiest(projects: DataFrame, scores: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` highest scores of each portfolio, ties by external id."""
    order = W.partitionBy("portfolio_id").orderBy(F.desc("score"), "project_id_external")
    joined = projects.select(
        "portfolio_id", "project_id", "project_id_external", "project_name", "final_status"
    ).join(scores.select("portfolio_id", "project_id", "score"), ["portfolio_id", "project_id"])
    return joined.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def monitor(projects: DataFrame, scores: DataFrame) -> DataFrame:
    """Running projects, riskiest first, unscored last."""
    return (
        projects.where(F.col("final_status") == S.IN_PROGRESS)
        .join(scores.select("portfolio_id", "project_id", "score"), ["portfolio_id", "project_id"], "left")
        .orderBy("portfolio_id", F.desc_nulls_last("score"), "project_id_external")
    )


def known_flags() -> Column:
    names = [flag for flag, _ in S.FLAG_CATEGORIES]
    return F.filter(F.coalesce("anomaly_flags", F.array().cast("array<string>")), lambda f: f.isin(names))


def flagged(projects: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Projects with known flags: scored ones by score, the others behind them
    by number of flags; without any scores by number of flags."""
    rows = projects.withColumn("flags", known_flags()).where(F.size("flags") > 0)
    rows = rows.withColumn("n_flags", F.size("flags"))
    if scores is None:
        return rows.orderBy("portfolio_id", F.desc("n_flags"), "project_id_external")
    return rows.join(
        scores.select("portfolio_id", "project_id", "score"), ["portfolio_id", "project_id"], "left"
    ).orderBy(
        "portfolio_id",
        F.desc_nulls_last("score"),
        F.when(F.col("score").isNull(), F.col("n_flags")).desc_nulls_last(),
        "project_id_external",
    )


def flag_categories(projects: DataFrame) -> DataFrame:
    """Flagged projects per category in fixed order, zero rows kept.

    A flag occurs at most once per category and project, so four conditional
    counts replace a distinct count over exploded flags."""
    counted = projects.groupBy("portfolio_id").agg(
        *[F.count_if(F.array_contains("anomaly_flags", flag)).alias(category) for flag, category in S.FLAG_CATEGORIES]
    )
    lines = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("category"), F.col(c).alias("n_projects"))
        for i, (_, c) in enumerate(S.FLAG_CATEGORIES)
    ]
    return counted.select("portfolio_id", F.inline(F.array(*lines)))


def flag_reasons(projects: DataFrame) -> DataFrame:
    """One row per known flag with the wording that names value and limit."""
    def worded(value: Column, known: Column, unknown: str) -> Column:
        return F.when(value.isNull(), F.lit(unknown)).otherwise(known)

    def number(name: str) -> Column:
        """Whole numbers without a trailing .0"""
        value = F.col(name).cast("double")
        return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))

    flag = F.col("flag")
    reasons = {
        "cost_overrun_high": worded(
            F.col("cost_overrun_pct"),
            F.concat(F.lit("Overrun "), F.format_string("%.1f%%", F.col("cost_overrun_pct").cast("double")),
                     F.lit(" exceeds 25% threshold")),
            "Overrun exceeds 25% threshold",
        ),
        "delay_days_high": worded(
            F.col("delay_days"),
            F.concat(F.lit("Delay "), number("delay_days"), F.lit(" days exceeds 150 day threshold")),
            "Delay exceeds 150 day threshold",
        ),
        "safety_incidents_high": worded(
            F.col("safety_incidents"),
            F.concat(number("safety_incidents"), F.lit(" safety incidents (threshold ≥ 5)")),
            "5 or more safety incidents",
        ),
        "payment_disputes_high": worded(
            F.col("payment_disputes"),
            F.concat(number("payment_disputes"), F.lit(" payment disputes (threshold ≥ 5)")),
            "5 or more payment disputes",
        ),
    }
    return projects.withColumn("flag", F.explode(known_flags())).select(
        "portfolio_id", "project_id", "flag",
        literal_lookup(flag, {k: F.lit(v) for k, v in S.FLAG_CATEGORIES}).alias("category"),
        literal_lookup(flag, reasons).alias("reason"),
    )


def flagged_share(projects: DataFrame) -> DataFrame:
    return projects.groupBy("portfolio_id").agg(
        F.count_if(F.size(known_flags()) > 0).alias("n_flagged"), F.count(F.lit(1)).alias("n_projects")
    )


def search(rows: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Case-insensitive substring over the joined text of ``columns`` (all by
    default); a blank query keeps everything."""
    needle = query.strip().lower()
    if not needle:
        return rows
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or rows.columns]
    return rows.where(F.lower(F.concat_ws(" ", *texts)).contains(needle))


def natural_key(text: Column) -> Column:
    """Sort key that orders digit runs by value, however long they are: a run
    without its leading zeros follows its length, and that the length's own."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))


    def ranked(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=.)", "")
        size = F.length(digits).cast("string")
        return F.when(part.rlike(r"^\d+$"), F.concat(F.length(size).cast("string"), size, digits)).otherwise(part)

    return F.when(text.isNotNull(), F.array_join(F.transform(parts, ranked), ""))


def sort_column(rows: DataFrame, column: str, descending: bool = False, tie: str = "project_id") -> DataFrame:
    """Nulls last ascending, first descending; text in natural number order."""
    key = F.col(column)
    if dict(rows.dtypes)[column] == "string":
        key = natural_key(key)
    return rows.orderBy(key.desc_nulls_first() if descending else key.asc_nulls_last(), tie)


def distribution(projects: DataFrame, measures: list[str]) -> DataFrame:
    """P10 / P50 / P90 per portfolio and measure with the relative position of
    the median; no percentiles below three values. Infinite values are left out."""
    quantiles = exact_quantiles(
        projects, ["portfolio_id"], {m: finite(F.col(m).cast("double")) for m in measures}, [0.1, 0.5, 0.9]
    )
    lines = [
        F.struct(
            F.lit(m).alias("measure"), F.col(f"{m}_n").alias("n"),
            *[F.when(F.col(f"{m}_n") >= 3, F.col(m)[i]).alias(p) for i, p in enumerate(["p10", "p50", "p90"])],
        )
        for m in measures
    ]
    spread = F.col("p90") - F.col("p10")
    position = F.when(spread == 0, 50.0).otherwise((F.col("p50") - F.col("p10")) / spread * 100)
    return quantiles.select("portfolio_id", F.inline(F.array(*lines))).withColumn(
        "median_position", F.when(F.col("p50").isNotNull(), position)
    )


def highlights(projects: DataFrame) -> DataFrame:
    return projects.select(
        "portfolio_id", "project_id",
        *[F.coalesce(F.col(c) > limit, F.lit(False)).alias(f"{c}_highlight") for c, limit in HIGHLIGHT_ABOVE.items()],
    )


def provenance(projects: DataFrame) -> DataFrame:
    source = F.coalesce("source", F.lit(S.SOURCE_CSV))
    return projects.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("n_projects"), F.count_if(source == S.SOURCE_MANUAL).alias("n_manual")
    )


def recent_portfolios(portfolios: DataFrame, n: int = 10) -> DataFrame:
    return portfolios.orderBy(F.desc("created_at"), "portfolio_id").limit(n)


def document_listing(documents: DataFrame) -> DataFrame:
    return documents.orderBy("portfolio_id", F.desc("uploaded_at"), "document_id")


def category_choices(projects: DataFrame, portfolios: DataFrame) -> DataFrame:
    """Selectable types and regions, one row per choice: distinct trimmed
    values of the portfolio, or the fixed fallback list where it has none."""
    fallback = {"project_type": S.FALLBACK_TYPES, "region": S.FALLBACK_REGIONS}
    pairs = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.trim(F.col(k)).alias("choice")) for k in fallback]
    )
    own = projects.select("portfolio_id", F.inline(pairs)).where("length(choice) > 0").distinct()
    kinds = portfolios.select("portfolio_id").distinct().withColumn(
        "kind", F.explode(F.array(*[F.lit(k) for k in fallback]))
    )
    missing = kinds.join(own.select("portfolio_id", "kind").distinct(), ["portfolio_id", "kind"], "left_anti")
    defaults = missing.withColumn(
        "choice",
        F.explode(literal_lookup(F.col("kind"), {k: F.array(*[F.lit(v) for v in vs]) for k, vs in fallback.items()})),
    )
    return own.unionByName(defaults).orderBy("portfolio_id", "kind", "choice")
