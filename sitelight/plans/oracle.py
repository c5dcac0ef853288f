"""The registered queries once more, as plain SQL over the same tables.

Common table expressions are named once; ``sql(body, *names)`` prefixes the
ones a query needs.
"""

from __future__ import annotations

CTES: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = body
    NEEDS[name] = list(needs)


def sql(body: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS[name]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in ordered)
    return f"WITH {head} {body}" if head else body


# --- project-shaped views ----------------------------------------------------
cte("cust", """
    SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name, r_name
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("proj", """
    SELECT c_mktsegment AS portfolio_id, o_orderkey AS project_id,
      'PRJ' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(9, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS project_id_external,
      c_name AS project_name, o_orderpriority AS project_type,
      o_totalprice * 200 AS contract_value_usd, CAST(o_orderdate AS DATE) AS start_date,
      CASE WHEN o_orderstatus = 'F' THEN CAST(last_ship AS DATE) END AS end_date,
      r_name AS region, subs AS subcontractor_count, qty AS delay_days, disc AS cost_overrun_pct,
      incidents AS safety_incidents, disputes AS payment_disputes,
      CASE WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'In Progress' END AS final_status,
      CASE WHEN o_orderstatus = 'F'
        THEN date_diff('day', CAST(o_orderdate AS DATE), CAST(last_ship AS DATE)) END AS actual_duration_days
    FROM orders LEFT JOIN (
      SELECT l_orderkey, max(l_shipdate) AS last_ship, count(DISTINCT l_suppkey) AS subs,
        sum(l_quantity) AS qty, sum(round(l_discount * 100)) AS disc,
        count(*) FILTER (WHERE l_returnflag = 'R') AS incidents,
        count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS disputes
      FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    LEFT JOIN cust ON o_custkey = c_custkey""", "cust")
FLAGS = """[x FOR x IN [
      CASE WHEN cost_overrun_pct > 25 THEN 'cost_overrun_high' END,
      CASE WHEN delay_days > 150 THEN 'delay_days_high' END,
      CASE WHEN safety_incidents >= 5 THEN 'safety_incidents_high' END,
      CASE WHEN payment_disputes >= 5 THEN 'payment_disputes_high' END] IF x IS NOT NULL]"""
cte("stored", f"SELECT *, {FLAGS} AS anomaly_flags FROM proj", "proj")

# --- cleaning ------------------------------------------------------------------
cte("raw", """
    SELECT * EXCLUDE (project_id, project_id_external, actual_duration_days, number), project_id AS ord,
      CASE WHEN ord % 97 <> 0 THEN 'PRJ' || lpad(number, CAST(greatest(9, length(number)) AS INTEGER), '0') END AS project_id
    FROM (SELECT *, CAST(CASE WHEN project_id % 10 = 3 THEN project_id - 10 ELSE project_id END AS VARCHAR) AS number FROM proj)""", "proj")
cte("firsts", """
    SELECT * EXCLUDE (copy), date_diff('day', start_date, end_date) AS actual_duration_days FROM (
      SELECT *, row_number() OVER (PARTITION BY portfolio_id, project_id ORDER BY ord) AS copy
      FROM raw WHERE project_id IS NOT NULL) WHERE copy = 1""", "raw")
NUMERIC = ["contract_value_usd", "subcontractor_count", "delay_days", "cost_overrun_pct",
           "safety_incidents", "payment_disputes"]
OUTCOME = ["safety_incidents", "payment_disputes"]
cte("med", "SELECT portfolio_id, " + ", ".join(f"median({c}) AS m_{c}" for c in NUMERIC)
    + " FROM firsts WHERE final_status = 'Completed' GROUP BY portfolio_id", "firsts")


def _fill(c: str) -> str:
    gap = f"{c} IS NULL" + (" AND final_status = 'Completed'" if c in OUTCOME else "")
    return f"CASE WHEN {gap} THEN m_{c} ELSE {c} END"


def _gap(c: str) -> str:
    return f"{c} IS NULL" + (" AND final_status = 'Completed'" if c in OUTCOME else "")


cte("filled", "SELECT f.* REPLACE (" + ", ".join(f"{_fill(c)} AS {c}" for c in NUMERIC)
    + ") FROM firsts f LEFT JOIN med USING (portfolio_id)", "med")
cte("cleaned", f"SELECT *, {FLAGS} AS anomaly_flags FROM filled", "filled")
cte("fills", " UNION ALL ".join(
    f"SELECT portfolio_id, {i} AS position, '{c}' AS \"column\", count(*) FILTER (WHERE {_gap(c)}) AS n_filled, "
    f"any_value(m_{c}) AS value FROM firsts JOIN med USING (portfolio_id) GROUP BY portfolio_id"
    for i, c in enumerate(NUMERIC)), "firsts", "med")

# --- segments --------------------------------------------------------------------
BUCKET = """CASE WHEN contract_value_usd IS NULL OR contract_value_usd < 25000000 THEN 'small'
      WHEN contract_value_usd < 75000000 THEN 'medium' ELSE 'large' END"""
NORM_DELAY = "CASE WHEN actual_duration_days >= 0 THEN delay_days / (actual_duration_days + 1.0) END"
cte("feat", """
    SELECT p.*, ln(1 + coalesce(contract_value_usd, mv, 0)) AS log_value,
      CAST(coalesce(subcontractor_count, ms, 0) AS DOUBLE) AS subs,
      coalesce(project_type, 'unknown') AS type_key, coalesce(region, 'unknown') AS region_key
    FROM stored p LEFT JOIN (SELECT portfolio_id, median(contract_value_usd) AS mv,
      median(subcontractor_count) AS ms FROM proj GROUP BY portfolio_id) USING (portfolio_id)""", "stored")

# --- risk --------------------------------------------------------------------------
cte("by_type", """
    SELECT portfolio_id, project_type, count(*) FILTER (WHERE cost_overrun_pct > 25) / CAST(count(*) AS DOUBLE) AS type_rate
    FROM proj WHERE final_status = 'Completed' AND project_type IS NOT NULL GROUP BY ALL""", "proj")
cte("by_region", """
    SELECT portfolio_id, region, count(*) FILTER (WHERE payment_disputes >= 1) / CAST(count(*) AS DOUBLE) AS region_rate
    FROM proj WHERE final_status = 'Completed' AND region IS NOT NULL GROUP BY ALL""", "proj")
cte("tops", """
    SELECT portfolio_id, max(contract_value_usd) AS max_value, max(subcontractor_count) AS max_subs
    FROM proj GROUP BY portfolio_id""", "proj")
cte("sub", f"""
    SELECT portfolio_id, project_id,
      round_even(coalesce(type_rate, 0.5), 4) AS type_risk,
      round_even(coalesce(region_rate, 0.5), 4) AS region_risk,
      round_even(CASE WHEN contract_value_usd IS NULL OR NOT max_value > 0 THEN 0
        ELSE least(1.0, ln(1 + contract_value_usd) / ln(1 + max_value)) END, 4) AS size_risk,
      round_even(CASE WHEN subcontractor_count IS NULL THEN 0
        ELSE least(1.0, subcontractor_count / CAST(greatest(1, coalesce(max_subs, 1)) AS DOUBLE)) END, 4) AS complexity_risk,
      round_even(coalesce(dur, 0.5), 4) AS duration_risk,
      concat_ws(',', CASE WHEN type_rate IS NULL THEN 'sparse_type' END,
        CASE WHEN region_rate IS NULL THEN 'sparse_region' END,
        CASE WHEN dur IS NULL THEN 'unknown_duration' END) AS flags
    FROM (SELECT p.*, type_rate, region_rate, max_value, max_subs,
        CASE WHEN final_status = 'Completed' AND ({NORM_DELAY}) IS NOT NULL
          THEN greatest(0.0, least(1.0, {NORM_DELAY})) END AS dur
      FROM proj p LEFT JOIN by_type USING (portfolio_id, project_type)
      LEFT JOIN by_region USING (portfolio_id, region) LEFT JOIN tops USING (portfolio_id))""",
    "by_type", "by_region", "tops")
DIMS = ["type_risk", "region_risk", "size_risk", "complexity_risk", "duration_risk"]
TOTAL = " + ".join(f"CAST({d} AS DOUBLE) * CAST(0.2 AS DOUBLE)" for d in DIMS)
DRIVER = "CASE " + " ".join(
    f"WHEN {d} = greatest({', '.join(DIMS)}) THEN '{d}'" for d in DIMS) + " END"
cte("score", f"""
    SELECT *, CAST(least(100, greatest(0, round_even(({TOTAL}) * 100, 0))) AS INTEGER) AS score, {DRIVER} AS top_driver
    FROM sub""", "sub")

# --- rules -----------------------------------------------------------------------------
cte("hits", f"""
    SELECT portfolio_id, project_type, region, {BUCKET} AS size_bucket,
      coalesce(cost_overrun_pct > 25, false) AS high_overrun, coalesce(delay_days > 150, false) AS high_delay,
      coalesce(safety_incidents >= 1, false) AS any_safety_incident, coalesce(payment_disputes >= 1, false) AS any_dispute
    FROM proj WHERE final_status = 'Completed'""", "proj")
OUTCOMES = ["high_overrun", "high_delay", "any_safety_incident", "any_dispute"]
cte("grid", " UNION ALL ".join(
    f"SELECT portfolio_id, '{s}=' || {s} AS scope, '{o}' AS outcome, count(*) AS n, count(*) FILTER (WHERE {o}) AS k "
    f"FROM hits WHERE {s} IS NOT NULL GROUP BY portfolio_id, {s}"
    for s in ["project_type", "region", "size_bucket"] for o in OUTCOMES), "hits")


def wilson(k: str, n: str) -> tuple[str, str]:
    p = f"({k} / CAST({n} AS DOUBLE))"
    z2 = "3.8416::DOUBLE"
    centre = f"({p} + {z2} / (2 * {n})) / (1 + {z2} / {n})"
    half = f"1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0::DOUBLE * {n} * {n})) / (1 + {z2} / {n})"
    low = f"CASE WHEN {n} > 0 THEN greatest(0.0, {centre} - {half}) ELSE 0.0 END"
    high = f"CASE WHEN {n} > 0 THEN least(1.0, {centre} + {half}) ELSE 0.0 END"
    return low, high


def confidence(n: str) -> str:
    return f"CASE WHEN {n} < 3 THEN 'low' WHEN {n} < 6 THEN 'medium' ELSE 'high' END"


_low, _high = wilson("k", "n")
cte("rule", f"""
    SELECT portfolio_id, scope, outcome, round_even(k / CAST(n AS DOUBLE), 4) AS rate, n AS sample_size,
      round_even({_low}, 4) AS ci_low, round_even({_high}, 4) AS ci_high, {confidence('n')} AS confidence
    FROM grid WHERE n >= 3 OR k = 0 OR k = n""", "grid")
cte("base", """
    SELECT portfolio_id, outcome, sum(rate * sample_size) / sum(sample_size) AS baseline
    FROM rule GROUP BY portfolio_id, outcome""", "rule")
cte("sal", """
    SELECT *, abs(rate - baseline) * CASE confidence WHEN 'low' THEN 0.5 WHEN 'medium' THEN 1.0 ELSE 1.5 END
      * sqrt(sample_size) AS salience
    FROM rule JOIN base USING (portfolio_id, outcome)""", "base")


def oracle_sql() -> dict[str, str]:
    """Query name to SQL, from all sections."""
    from sitelight.plans import oracle_more

    return {**_core(), **oracle_more.statements()}


def _core() -> dict[str, str]:
    numbers = ", ".join(NUMERIC)
    out: dict[str, str] = {}
    # cleaning
    out["c1_reject_null_keys"] = sql("SELECT portfolio_id, project_id, ord FROM raw WHERE project_id IS NOT NULL", "raw")
    out["c2_keep_first"] = sql("SELECT portfolio_id, project_id, ord FROM firsts", "firsts")
    out["c3_to_number"] = sql("""
        SELECT o_orderkey, try_cast(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS from_price,
          CAST(NULL AS DOUBLE) AS from_priority, CAST(NULL AS DOUBLE) AS from_suffixed,
          CAST(o_custkey AS DOUBLE) AS from_padded FROM orders""")
    out["c4_to_date"] = sql("""
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_iso, CAST(NULL AS DATE) AS from_slashes,
          CAST(NULL AS DATE) AS from_impossible FROM orders""")
    out["c5_duration"] = sql("SELECT project_id, portfolio_id, actual_duration_days FROM firsts", "firsts")
    report = [(c, "double") for c in NUMERIC] + [("start_date", "date"), ("end_date", "date")]
    out["c6_coercion_report"] = sql(
        " UNION ALL ".join(
            f"SELECT portfolio_id, {i} AS position, '{c}' AS \"column\", 'string' AS \"from\", '{t}' AS \"to\", 0 AS n_invalid FROM raw GROUP BY portfolio_id"
            for i, (c, t) in enumerate(report))
        + f" UNION ALL SELECT portfolio_id, {len(report)}, 'actual_duration_days', 'derived', 'int', 0 FROM raw GROUP BY portfolio_id", "raw")
    out["c7_impute_medians"] = sql(f"SELECT portfolio_id, project_id, {numbers} FROM filled", "filled")
    out["c7_imputation_report"] = sql("SELECT * FROM fills WHERE n_filled > 0 AND value IS NOT NULL", "fills")
    out["c8_anomaly_flags"] = sql("SELECT portfolio_id, project_id, array_to_string(anomaly_flags, ',') AS anomaly_flags FROM stored", "stored")
    out["c9_cleaning_summary"] = sql("""
        SELECT b.portfolio_id, row_count, anomaly_count, n_before - row_count AS rows_rejected, imputations, 9 AS n_coercions
        FROM (SELECT portfolio_id, count(*) AS n_before FROM raw GROUP BY 1) b
        JOIN (SELECT portfolio_id, count(*) AS row_count, count(*) FILTER (WHERE len(anomaly_flags) > 0) AS anomaly_count
              FROM cleaned GROUP BY 1) USING (portfolio_id)
        LEFT JOIN (SELECT portfolio_id, string_agg("column" || ':' || n_filled || ':' || CAST(CAST(round(value, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY position) AS imputations
              FROM fills WHERE n_filled > 0 AND value IS NOT NULL GROUP BY 1) USING (portfolio_id)""", "cleaned", "fills")
    out["c10_project_columns"] = sql("""
        SELECT portfolio_id, project_id AS project_id_external, project_name, project_type, contract_value_usd,
          start_date, end_date, region, CAST(subcontractor_count AS DOUBLE) AS subcontractor_count, delay_days, cost_overrun_pct,
          CAST(safety_incidents AS DOUBLE) AS safety_incidents, CAST(payment_disputes AS DOUBLE) AS payment_disputes,
          final_status, actual_duration_days, CAST(NULL AS VARCHAR) AS anomaly_flags FROM firsts""", "firsts")
    out["c11_validate_valid"] = sql("""
        SELECT user_id, event_id, contract_value_usd, actual_duration_days FROM (
          SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value - 20 END AS contract_value_usd,
            CASE WHEN event_type = 'signup' THEN 30 ELSE 7 END AS actual_duration_days, event_type FROM events)
        WHERE event_type <> 'error' AND event_type <> 'click' AND (contract_value_usd IS NULL OR contract_value_usd >= 0)""")
    out["c11_validate_rejected"] = sql("""
        SELECT event_id, concat_ws(',', CASE WHEN event_type <> 'view' AND value - 20 < 0 THEN 'negative:contract_value_usd' END,
            CASE WHEN event_type = 'click' THEN 'bad_date:start_date' END,
            CASE WHEN event_type = 'error' THEN 'bad_status' END) AS errors
        FROM events WHERE event_type IN ('error', 'click') OR (event_type <> 'view' AND value - 20 < 0)""")
    out["c12_clean"] = sql("""
        SELECT portfolio_id, project_id AS project_id_external, project_name, project_type, round(contract_value_usd, 2) AS contract_value_usd,
          start_date, end_date, region, subcontractor_count, delay_days, cost_overrun_pct, safety_incidents, payment_disputes,
          final_status, actual_duration_days, array_to_string(anomaly_flags, ',') AS anomaly_flags FROM cleaned""", "cleaned")
    # segments
    out["g1_size_bucket"] = sql(f"SELECT project_id, {BUCKET} AS size_bucket FROM proj", "proj")
    out["g2_normalized_delay"] = sql(f"SELECT project_id, round({NORM_DELAY}, 6) AS normalized_delay FROM proj", "proj")
    out["g3_cluster_features"] = sql("SELECT project_id, round(log_value, 6) AS log_value, subs, type_key, region_key FROM feat", "feat")
    out["g5_segments"] = sql(f"SELECT portfolio_id, project_id, {BUCKET} AS size_bucket, round({NORM_DELAY}, 6) AS normalized_delay FROM proj", "proj")
    # risk
    out["k1_type_risk"] = sql("SELECT portfolio_id, project_type, round(type_rate, 6) AS type_rate FROM by_type", "by_type")
    out["k2_region_risk"] = sql("SELECT portfolio_id, region, round(region_rate, 6) AS region_rate FROM by_region", "by_region")
    out["k3_size_pressure"] = sql("SELECT project_id, size_risk FROM sub", "sub")
    out["k4_complexity"] = sql("SELECT project_id, complexity_risk FROM sub", "sub")
    out["k5_duration_pressure"] = sql("SELECT project_id, duration_risk, contains(flags, 'unknown_duration') AS unknown_duration FROM sub", "sub")
    out["k6_composite"] = sql("SELECT project_id, score FROM score", "score")
    out["k7_top_driver"] = sql("SELECT project_id, top_driver FROM score", "score")
    out["k8_flags"] = sql("SELECT project_id, flags FROM sub", "sub")
    out["k9_scores"] = sql("SELECT portfolio_id, project_id, score, type_risk, region_risk, size_risk, complexity_risk, duration_risk, top_driver, flags FROM score", "score")
    points = " UNION ALL ".join(f"SELECT portfolio_id, project_id, '{d}' AS dimension, {i} AS tie, CAST({d} AS DOUBLE) * CAST(0.2 AS DOUBLE) * 100 AS points FROM sub" for i, d in enumerate(DIMS))
    out["k10_contributions"] = sql(f"""
        SELECT portfolio_id, project_id, dimension, round(points, 4) AS points,
          row_number() OVER (PARTITION BY project_id ORDER BY points DESC, tie) AS position FROM ({points})""", "sub")
    out["k11_risk_band"] = sql("SELECT project_id, CASE WHEN score <= 34 THEN 'success' WHEN score <= 64 THEN 'warning' ELSE 'destructive' END AS band FROM score", "score")
    # rules
    out["d1_wilson"] = sql("SELECT portfolio_id, scope, outcome, n, k, round(" + _low + ", 6) AS ci_low, round(" + _high + ", 6) AS ci_high FROM grid", "grid")
    out["d2_confidence"] = sql(f"SELECT o_custkey, count(*) AS n, {confidence('count(*)')} AS confidence FROM orders GROUP BY o_custkey")
    out["d3_outcomes"] = sql("SELECT project_id, coalesce(cost_overrun_pct > 25, false) AS high_overrun, coalesce(delay_days > 150, false) AS high_delay, coalesce(safety_incidents >= 1, false) AS any_safety_incident, coalesce(payment_disputes >= 1, false) AS any_dispute FROM proj", "proj")
    out["d4_emission_gate"] = sql("""
        SELECT o_custkey, n, k FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS k
          FROM orders GROUP BY o_custkey) WHERE n >= 3 OR k = 0 OR k = n""")
    out["d5_rules"] = sql("SELECT * FROM rule", "rule")
    out["d6_baselines"] = sql("SELECT portfolio_id, outcome, round(baseline, 6) AS baseline FROM base", "base")
    out["d7_salience"] = sql("SELECT portfolio_id, scope, outcome, round(salience, 6) AS salience FROM sal", "sal")
    ranked = "(SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY round(salience, 9) DESC, scope, outcome) AS position FROM sal)"
    out["d8_top_signals"] = sql(f"SELECT portfolio_id, scope, outcome, round(salience, 6) AS salience, position FROM {ranked} WHERE position <= 12", "sal")
    out["d8_overview_signals"] = sql(f"SELECT portfolio_id, scope, outcome, round(salience, 6) AS salience, position FROM {ranked} WHERE position <= 5", "sal")
    out["d9_fired_rules"] = sql("SELECT * FROM rule WHERE rate >= 0.5 OR (rate <= 0.2 AND sample_size >= 3)", "rule")
    out["d10_insights"] = sql("""
        SELECT portfolio_id, scope, outcome,
          CASE split_part(scope, '=', 1) WHEN 'size_bucket' THEN split_part(scope, '=', 2) || ' size-bucket'
            WHEN 'region' THEN split_part(scope, '=', 2) || ' region' ELSE split_part(scope, '=', 2) END AS subject,
          CASE outcome WHEN 'high_overrun' THEN 'cost overrun above 25%' WHEN 'high_delay' THEN 'delays beyond 150 days'
            WHEN 'any_safety_incident' THEN 'at least one safety incident' ELSE 'at least one payment dispute' END AS phrase,
          round(rate - baseline, 6) AS delta, abs(rate - baseline) >= 0.02 AND baseline > 0 AS has_comparison,
          confidence = 'low' AS dimmed FROM sal""", "sal")
    out["d11_rule_listing"] = sql("SELECT * FROM rule", "rule")
    # dashboard
    out["q1_kpis"] = sql("""
        SELECT p.portfolio_id, round(sum(contract_value_usd), 0) AS total_contract_usd, count(*) AS n_projects,
          count(*) FILTER (WHERE final_status = 'Completed') AS n_completed,
          count(*) FILTER (WHERE final_status = 'In Progress') AS n_in_progress,
          round(avg(delay_days), 6) AS mean_delay_days, round(avg(score), 6) AS mean_risk, count(score) AS n_scored
        FROM stored p LEFT JOIN score USING (project_id) GROUP BY p.portfolio_id""", "stored", "score")
    out["q2_mean_delay_by_type"] = sql("SELECT portfolio_id, project_type, round(avg(delay_days), 2) AS mean_delay_days FROM proj WHERE delay_days IS NOT NULL GROUP BY ALL", "proj")
    out["q2_mean_overrun_by_type"] = sql("SELECT portfolio_id, project_type, round(avg(cost_overrun_pct), 2) AS mean_cost_overrun_pct FROM proj WHERE cost_overrun_pct IS NOT NULL GROUP BY ALL", "proj")
    out["q3_count_by_region"] = sql("SELECT portfolio_id, region, count(*) AS n_projects FROM proj GROUP BY ALL", "proj")
    out["q4_riskiest"] = sql("""
        SELECT * FROM (SELECT p.portfolio_id, project_id, project_id_external, project_name, final_status, score,
          row_number() OVER (PARTITION BY p.portfolio_id ORDER BY score DESC, project_id_external) AS position
          FROM proj p JOIN score USING (project_id)) WHERE position <= 5""", "proj", "score")
    out["q5_monitor"] = sql("SELECT p.portfolio_id, project_id, project_id_external, score FROM proj p LEFT JOIN score USING (project_id) WHERE final_status = 'In Progress'", "proj", "score")
    out["q6_flagged"] = sql("SELECT p.portfolio_id, project_id, array_to_string(anomaly_flags, ',') AS flags, len(anomaly_flags) AS n_flags, score FROM stored p LEFT JOIN score USING (project_id) WHERE len(anomaly_flags) > 0", "stored", "score")
    cats = [("cost_overrun_high", "cost_overrun"), ("delay_days_high", "schedule_delay"), ("safety_incidents_high", "safety"), ("payment_disputes_high", "disputes")]
    out["q7_flag_categories"] = sql(" UNION ALL ".join(
        f"SELECT portfolio_id, {i + 1} AS position, '{c}' AS category, count(*) FILTER (WHERE list_contains(anomaly_flags, '{f}')) AS n_projects FROM stored GROUP BY portfolio_id"
        for i, (f, c) in enumerate(cats)), "stored")
    out["q8_flag_reasons"] = sql("""
        SELECT portfolio_id, project_id, flag,
          CASE flag WHEN 'cost_overrun_high' THEN 'cost_overrun' WHEN 'delay_days_high' THEN 'schedule_delay'
            WHEN 'safety_incidents_high' THEN 'safety' ELSE 'disputes' END AS category,
          CASE flag WHEN 'cost_overrun_high' THEN 'Overrun ' || CAST(CAST(cost_overrun_pct AS DECIMAL(18, 1)) AS VARCHAR) || '% exceeds 25% threshold'
            WHEN 'delay_days_high' THEN 'Delay ' || CAST(CAST(delay_days AS BIGINT) AS VARCHAR) || ' days exceeds 150 day threshold'
            WHEN 'safety_incidents_high' THEN safety_incidents || ' safety incidents (threshold ≥ 5)'
            ELSE payment_disputes || ' payment disputes (threshold ≥ 5)' END AS reason
        FROM (SELECT *, unnest(anomaly_flags) AS flag FROM stored)""", "stored")
    out["q9_flagged_share"] = sql("SELECT portfolio_id, count(*) FILTER (WHERE len(anomaly_flags) > 0) AS n_flagged, count(*) AS n_projects FROM stored GROUP BY portfolio_id", "stored")
    out["q10_search"] = sql("SELECT project_id, project_name FROM proj WHERE contains(lower(project_name || ' ' || project_id_external), 'r#00000012')", "proj")
    out["q11_sort_asc"] = sql("SELECT project_id, end_date FROM proj", "proj")
    out["q11_sort_desc"] = sql("""
        SELECT c_custkey, n_name, 'nation_' || length(CAST(length(digits) AS VARCHAR)) || length(digits) || digits AS sort_key
        FROM (SELECT *, CAST(CAST(replace(n_name, 'NATION_', '') AS BIGINT) AS VARCHAR) AS digits FROM cust)""", "cust")
    dist = []
    for m in ["delay_days", "cost_overrun_pct", "contract_value_usd"]:
        q = [f"quantile_cont({m}, {p})" for p in ("0.1", "0.5", "0.9")]
        dist.append(f"""SELECT portfolio_id, '{m}' AS measure, count({m}) AS n,
          {', '.join(f'round(CASE WHEN count({m}) >= 3 THEN {e} END, 4) AS {a}' for e, a in zip(q, ('p10', 'p50', 'p90')))},
          round(CASE WHEN count({m}) >= 3 THEN CASE WHEN {q[2]} = {q[0]} THEN 50 ELSE ({q[1]} - {q[0]}) / ({q[2]} - {q[0]}) * 100 END END, 4) AS median_position
          FROM proj GROUP BY portfolio_id""")
    out["q12_distribution"] = sql(" UNION ALL ".join(dist), "proj")
    out["q13_highlights"] = sql("""
        SELECT portfolio_id, project_id, coalesce(delay_days > 30, false) AS delay_days_highlight,
          coalesce(cost_overrun_pct > 25, false) AS cost_overrun_pct_highlight,
          coalesce(safety_incidents > 0, false) AS safety_incidents_highlight,
          coalesce(payment_disputes > 0, false) AS payment_disputes_highlight FROM proj""", "proj")
    out["q14_provenance"] = sql("SELECT portfolio_id, count(*) AS n_projects, count(*) FILTER (WHERE project_type = '1-URGENT') AS n_manual FROM proj GROUP BY portfolio_id", "proj")
    out["q15_recent_portfolios"] = sql("SELECT c_custkey AS portfolio_id, max(o_orderdate) AS created_at FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY created_at DESC, portfolio_id LIMIT 10")
    out["q16_document_listing"] = sql("SELECT doc_id AS document_id, lang AS portfolio_id, n_chars AS uploaded_at FROM documents")
    out["n10_category_choices"] = sql("""
        SELECT DISTINCT portfolio_id, 'project_type' AS kind, project_type AS choice FROM proj
        UNION ALL SELECT DISTINCT portfolio_id, 'region', region FROM proj
        UNION ALL SELECT n_name, 'project_type', unnest(['Commercial', 'Energy', 'Industrial', 'Infrastructure', 'Residential']) FROM nation
        UNION ALL SELECT n_name, 'region', unnest(['Midwest', 'Mountain', 'Northeast', 'Southeast', 'Southwest']) FROM nation""", "proj")
    return out
