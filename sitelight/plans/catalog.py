"""Every operator as a named query over the given tables.

A query takes (spark, folder of parquet tables) and returns a DataFrame of
scalar columns; nested results are flattened and reals rounded, so that they
compare with plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelight import schema as S
from sitelight.functions import columns as C
from sitelight.operators import cleaning, dashboard, risk, rules, segments
from sitelight.plans.common import joined, rounded
from sitelight.sources import marts

Query = Callable[[SparkSession, str], DataFrame]


def _raw(spark, sf):
    return marts.raw_projects(spark, sf)


def _first(spark, sf):
    return cleaning.keep_first(cleaning.reject_null_keys(_raw(spark, sf)))


def _typed(spark, sf):
    return cleaning.coerce_types(_first(spark, sf))


def _orders(spark, sf):
    return marts.table(spark, sf, "orders")


# --- cleaning -------------------------------------------------------------------
def c1_reject_null_keys(spark, sf):
    return cleaning.reject_null_keys(_raw(spark, sf)).select("portfolio_id", "project_id", F.col("_ord.row").alias("ord"))


def c2_keep_first(spark, sf):
    return _first(spark, sf).select("portfolio_id", "project_id", F.col("_ord.row").alias("ord"))


def c3_to_number(spark, sf):
    return _orders(spark, sf).select(
        "o_orderkey",
        C.to_number(F.col("o_totalprice").cast("string")).alias("from_price"),
        C.to_number(F.col("o_orderpriority")).alias("from_priority"),
        C.to_number(F.concat(F.col("o_custkey").cast("string"), F.lit("d"))).alias("from_suffixed"),
        C.to_number(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))).alias("from_padded"),
    )


def c4_to_date(spark, sf):
    day = F.to_date("o_orderdate")
    return _orders(spark, sf).select(
        "o_orderkey",
        C.to_iso_date(day.cast("string")).alias("from_iso"),
        C.to_iso_date(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("from_slashes"),
        C.to_iso_date(F.concat(F.year(day).cast("string"), F.lit("-02-30"))).alias("from_impossible"),
    )


def c5_duration(spark, sf):
    return _typed(spark, sf).select("project_id", "portfolio_id", "actual_duration_days")


def c6_coercion_report(spark, sf):
    return cleaning.coercion_report(_raw(spark, sf))


def c7_impute_medians(spark, sf):
    return cleaning.impute_medians(_typed(spark, sf)).select("portfolio_id", "project_id", *S.NUMERIC_COLUMNS)


def c7_imputation_report(spark, sf):
    return cleaning.imputation_report(_typed(spark, sf))


def c8_anomaly_flags(spark, sf):
    return marts.projects(spark, sf).select("portfolio_id", "project_id", joined("anomaly_flags"))


def c9_cleaning_summary(spark, sf):
    _, summary = cleaning.clean(_raw(spark, sf))
    line = lambda e: F.concat_ws(":", e["column"], e["n_filled"].cast("string"), F.round(e["value"]).cast("bigint").cast("string"))
    return summary.select(
        "portfolio_id", "row_count", "anomaly_count", "rows_rejected",
        F.nullif(F.array_join(F.transform("imputations", line), ","), F.lit("")).alias("imputations"),
        F.size("coercions").alias("n_coercions"),
    )


def c10_project_columns(spark, sf):
    typed = _typed(spark, sf).withColumn("anomaly_flags", F.lit(None).cast("string"))
    return cleaning.project_columns(typed)


def _manual_entries(spark, sf):
    """Events as hand-typed rows, some of them wrong in a known way."""
    kind = F.col("event_type")
    return marts.table(spark, sf, "events").select(
        "event_id", "user_id",
        F.col("event_id").cast("string").alias("project_id_external"),
        kind.alias("project_name"),
        F.lit("  ").alias("project_type"),
        F.when(kind == "view", "").otherwise((F.col("value") - 20).cast("string")).alias("contract_value_usd"),
        F.when(kind == "click", "2024/01/01").otherwise("2024-01-01").alias("start_date"),
        F.when(kind == "signup", "2024-01-31").otherwise("").alias("end_date"),
        F.lit("").alias("region"),
        F.lit("3").alias("subcontractor_count"),
        F.lit("-4.5").alias("delay_days"),
        F.lit("").alias("cost_overrun_pct"),
        F.lit("0").alias("safety_incidents"),
        F.lit("").alias("payment_disputes"),
        F.when(kind == "error", "Paused").otherwise(S.COMPLETED).alias("final_status"),
        F.lit("7").alias("actual_duration_days"),
    )


def c11_validate_valid(spark, sf):
    valid, _ = cleaning.validate_projects(_manual_entries(spark, sf))
    return valid.select("user_id", "event_id", "contract_value_usd", "actual_duration_days")


def c11_validate_rejected(spark, sf):
    _, rejected = cleaning.validate_projects(_manual_entries(spark, sf))
    return rejected.select("event_id", joined("errors"))


def c12_clean(spark, sf):
    projects, _ = cleaning.clean(_raw(spark, sf))
    return rounded(projects.withColumn("anomaly_flags", F.array_join("anomaly_flags", ",")), 2)


# --- segments ----------------------------------------------------------------------
def g1_size_bucket(spark, sf):
    return marts.projects(spark, sf).select("project_id", segments.size_bucket(F.col("contract_value_usd")).alias("size_bucket"))


def g2_normalized_delay(spark, sf):
    ratio = segments.normalized_delay(F.col("delay_days"), F.col("actual_duration_days"))
    return rounded(marts.projects(spark, sf).select("project_id", ratio.alias("normalized_delay")))


def g3_cluster_features(spark, sf):
    return rounded(segments.cluster_features(marts.projects(spark, sf)).select("project_id", "log_value", "subs", "type_key", "region_key"))


def g5_segments(spark, sf):
    return rounded(segments.segments(marts.projects(spark, sf)).drop("cluster_id"))


# --- risk -------------------------------------------------------------------------------
def _scores(spark, sf):
    return risk.scores(marts.projects(spark, sf))


def k1_type_risk(spark, sf):
    cells = risk.peer_cells(marts.projects(spark, sf))
    return rounded(risk.peer_rate(cells, "project_type", "overruns", "type_rate"))


def k2_region_risk(spark, sf):
    cells = risk.peer_cells(marts.projects(spark, sf))
    return rounded(risk.peer_rate(cells, "region", "disputed", "region_rate"))


def _subscore(name):
    return lambda spark, sf: risk.subscores(marts.projects(spark, sf)).select("project_id", name)


def k5_duration_pressure(spark, sf):
    return risk.subscores(marts.projects(spark, sf)).select(
        "project_id", "duration_risk", F.array_contains("flags", "unknown_duration").alias("unknown_duration")
    )


def k6_composite(spark, sf):
    return _scores(spark, sf).select("project_id", "score")


def k7_top_driver(spark, sf):
    return _scores(spark, sf).select("project_id", "breakdown.top_driver")


def k8_flags(spark, sf):
    return risk.subscores(marts.projects(spark, sf)).select("project_id", joined("flags"))


def k9_scores(spark, sf):
    return _scores(spark, sf).select(
        "portfolio_id", "project_id", "score", "breakdown.subscores.*", "breakdown.top_driver",
        F.array_join("breakdown.flags", ",").alias("flags"),
    )


def k10_contributions(spark, sf):
    return rounded(risk.contributions(_scores(spark, sf)), 4)


def k11_risk_band(spark, sf):
    return _scores(spark, sf).select("project_id", risk.risk_band(F.col("score")).alias("band"))


# --- rules ---------------------------------------------------------------------------------
def _rules(spark, sf):
    return rules.rules(marts.projects(spark, sf))


def d1_wilson(spark, sf):
    finished = marts.projects(spark, sf).where(C.completed())
    bucketed = finished.withColumn("size_bucket", segments.size_bucket(F.col("contract_value_usd")))
    flags = rules.outcome_predicates()
    scopes = F.array(*[F.concat(F.lit(f"{s}="), F.col(s)) for s in S.SCOPES])
    cells = bucketed.groupBy("portfolio_id", *S.SCOPES).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(p).alias(o) for o, p in flags.items()]
    )
    counts = (
        cells.withColumn("scope", F.explode(scopes)).where("scope is not null")
        .groupBy("portfolio_id", "scope").agg(F.sum("n").alias("n"), *[F.sum(o).alias(o) for o in S.OUTCOMES])
        .unpivot(["portfolio_id", "scope", "n"], S.OUTCOMES, "outcome", "k")
    )
    low, high = C.wilson_interval(F.col("k"), F.col("n"))
    return rounded(counts.withColumns({"ci_low": low, "ci_high": high}))


def d2_confidence(spark, sf):
    counted = _orders(spark, sf).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("confidence", C.confidence_label(F.col("n")))


def d3_outcomes(spark, sf):
    return marts.projects(spark, sf).select("project_id", *[p.alias(o) for o, p in rules.outcome_predicates().items()])


def d4_emission_gate(spark, sf):
    return (
        _orders(spark, sf).groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
        .where(rules.emitted(F.col("k"), F.col("n")))
    )


def d5_rules(spark, sf):
    return _rules(spark, sf)


def d6_baselines(spark, sf):
    return rounded(rules.baselines(_rules(spark, sf)))


def d7_salience(spark, sf):
    return rounded(rules.with_salience(_rules(spark, sf)).select("portfolio_id", "scope", "outcome", "salience"))


def _signals(n):
    return lambda spark, sf: rounded(
        rules.top_signals(_rules(spark, sf), n).select("portfolio_id", "scope", "outcome", "salience", "position")
    )


def d9_fired_rules(spark, sf):
    return rules.fired_rules(_rules(spark, sf))


def d10_insights(spark, sf):
    return rounded(rules.insights(_rules(spark, sf)).select(
        "portfolio_id", "scope", "outcome", "subject", "phrase", "delta", "has_comparison", "dimmed"
    ))


def d11_rule_listing(spark, sf):
    return rules.listed_rules(_rules(spark, sf))


# --- dashboard ----------------------------------------------------------------------------------
def q1_kpis(spark, sf):
    projects = marts.projects(spark, sf)
    return rounded(dashboard.kpis(projects, risk.scores(projects)), total_contract_usd=0)


def _by_type(measure):
    return lambda spark, sf: dashboard.mean_by_type(marts.projects(spark, sf), measure)


def q3_count_by_region(spark, sf):
    return dashboard.count_by_region(marts.projects(spark, sf))


def q4_riskiest(spark, sf):
    projects = marts.projects(spark, sf)
    return dashboard.riskiest(projects, risk.scores(projects))


def q5_monitor(spark, sf):
    projects = marts.projects(spark, sf)
    return dashboard.monitor(projects, risk.scores(projects)).select(
        "portfolio_id", "project_id", "project_id_external", "score"
    )


def q6_flagged(spark, sf):
    projects = marts.projects(spark, sf)
    return dashboard.flagged(projects, risk.scores(projects)).select(
        "portfolio_id", "project_id", joined("flags"), "n_flags", "score"
    )


def q7_flag_categories(spark, sf):
    return dashboard.flag_categories(marts.projects(spark, sf))


def q8_flag_reasons(spark, sf):
    return dashboard.flag_reasons(marts.projects(spark, sf))


def q9_flagged_share(spark, sf):
    return dashboard.flagged_share(marts.projects(spark, sf))


def q10_search(spark, sf):
    found = dashboard.search(marts.projects(spark, sf), "  R#00000012", ["project_name", "project_id_external"])
    return found.select("project_id", "project_name")


def q11_sort_asc(spark, sf):
    return dashboard.sort_column(marts.projects(spark, sf), "end_date").select("project_id", "end_date")


def q11_sort_desc(spark, sf):
    ordered = dashboard.sort_column(marts.customers(spark, sf), "n_name", descending=True, tie="c_custkey")
    return ordered.select("c_custkey", "n_name", dashboard.natural_key(F.col("n_name")).alias("sort_key"))


def q12_distribution(spark, sf):
    return rounded(dashboard.distribution(marts.projects(spark, sf), ["delay_days", "cost_overrun_pct", "contract_value_usd"]), 4)


def q13_highlights(spark, sf):
    return dashboard.highlights(marts.projects(spark, sf))


def q14_provenance(spark, sf):
    source = F.when(F.col("project_type") == "1-URGENT", S.SOURCE_MANUAL)
    return dashboard.provenance(marts.projects(spark, sf).withColumn("source", source))


def q15_recent_portfolios(spark, sf):
    created = (
        _orders(spark, sf).groupBy(F.col("o_custkey").alias("portfolio_id"))
        .agg(F.max("o_orderdate").alias("created_at"))
    )
    return dashboard.recent_portfolios(created)


def q16_document_listing(spark, sf):
    documents = marts.table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("lang").alias("portfolio_id"),
        F.col("n_chars").alias("uploaded_at"),
    )
    return dashboard.document_listing(documents)


def n10_category_choices(spark, sf):
    """Portfolios with projects, and one without any per nation."""
    projects = marts.projects(spark, sf)
    empty = marts.table(spark, sf, "nation").select(F.col("n_name").alias("portfolio_id"))
    portfolios = projects.select("portfolio_id").distinct().unionByName(empty)
    return dashboard.category_choices(projects, portfolios)


def queries() -> dict[str, Query]:
    from sitelight.plans import catalog_more

    return {**_core(), **catalog_more.queries()}


def _core() -> dict[str, Query]:
    out: dict[str, Query] = {
        f.__name__: f
        for f in [
            c1_reject_null_keys, c2_keep_first, c3_to_number, c4_to_date, c5_duration, c6_coercion_report,
            c7_impute_medians, c7_imputation_report, c8_anomaly_flags, c9_cleaning_summary, c10_project_columns,
            c11_validate_valid, c11_validate_rejected, c12_clean,
            g1_size_bucket, g2_normalized_delay, g3_cluster_features, g5_segments,
            k1_type_risk, k2_region_risk, k5_duration_pressure, k6_composite, k7_top_driver, k8_flags,
            k9_scores, k10_contributions, k11_risk_band,
            d1_wilson, d2_confidence, d3_outcomes, d4_emission_gate, d5_rules, d6_baselines, d7_salience,
            d9_fired_rules, d10_insights, d11_rule_listing,
            q1_kpis, q3_count_by_region, q4_riskiest, q5_monitor, q6_flagged, q7_flag_categories,
            q8_flag_reasons, q9_flagged_share, q10_search, q11_sort_asc, q11_sort_desc, q12_distribution,
            q13_highlights, q14_provenance, q15_recent_portfolios, q16_document_listing, n10_category_choices,
        ]
    }
    out["k3_size_pressure"] = _subscore("size_risk")
    out["k4_complexity"] = _subscore("complexity_risk")
    out["d8_top_signals"] = _signals(12)
    out["d8_overview_signals"] = _signals(5)
    out["q2_mean_delay_by_type"] = _by_type("delay_days")
    out["q2_mean_overrun_by_type"] = _by_type("cost_overrun_pct")
    return out
