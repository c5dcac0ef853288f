"""SQL of the screening, model, retrieval, mutation and storage queries."""

from __future__ import annotations

from sitelight.plans.oracle import CTES, confidence, cte, sql, wilson

# --- screening -------------------------------------------------------------------
cte("bid", """
    SELECT c_custkey AS bid_id, CASE WHEN c_acctbal < 0 THEN 'UNASSIGNED' ELSE c_mktsegment END AS portfolio_id,
      o_orderpriority AS project_type, r_name AS region, ln(1 + greatest(0, c_acctbal * 10000)) AS lb,
      CAST(coalesce(n, 0) AS DOUBLE) AS sb, greatest(1, least(20, coalesce(n, 5))) AS k
    FROM cust LEFT JOIN (
      SELECT o_custkey, o_orderpriority, count(*) OVER (PARTITION BY o_custkey) AS n,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest
      FROM orders) ON o_custkey = c_custkey AND newest = 1""", "cust")
cte("asked", """
    SELECT b.*, sqrt(lb * lb + sb * sb
      + CASE WHEN EXISTS (SELECT 1 FROM feat f WHERE f.portfolio_id = b.portfolio_id AND f.type_key = b.project_type) THEN 1 ELSE 0 END
      + CASE WHEN EXISTS (SELECT 1 FROM feat f WHERE f.portfolio_id = b.portfolio_id AND f.region_key = b.region) THEN 1 ELSE 0 END) AS nb
    FROM bid b""", "bid", "feat")
DISTANCE = """greatest(0.0, least(2.0, 1.0 - (lb * log_value + sb * subs
      + CASE WHEN type_key = a.project_type THEN 1 ELSE 0 END + CASE WHEN region_key = a.region THEN 1 ELSE 0 END)
      / (nb * sqrt(log_value * log_value + subs * subs + 2))))"""
cte("near", f"""
    SELECT * FROM (
      SELECT bid_id, k, project_id, project_id_external, project_name, delay_days, cost_overrun_pct, safety_incidents,
        payment_disputes, distance, row_number() OVER (PARTITION BY bid_id ORDER BY round(distance, 12), project_id) AS position
      FROM (SELECT a.bid_id, a.k, f.project_id, project_id_external, project_name, delay_days, cost_overrun_pct, safety_incidents,
          payment_disputes, {DISTANCE} AS distance
        FROM asked a JOIN feat f ON a.portfolio_id = f.portfolio_id)) WHERE position <= k""", "asked", "feat")

# --- documents ----------------------------------------------------------------------
SPACES = "[\\t\\n\\v\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
cte("windows", f"""
    SELECT doc_id, lang, source, words, unnest(CASE WHEN len(words) = 0 THEN [] ELSE
      generate_series(0, greatest(0, CAST(ceil((len(words) - 400) / 350.0) AS BIGINT)) * 350, 350) END) AS start
    FROM (SELECT doc_id, lang, source, [w FOR w IN regexp_split_to_array(text, '{SPACES}') IF w <> ''] AS words FROM documents)""")
cte("chunk", """
    SELECT doc_id AS document_id, lang AS portfolio_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index,
      chunk_text FROM (SELECT doc_id, lang, start, array_to_string(words[start + 1:start + 400], ' ') AS chunk_text FROM windows)
    WHERE length(chunk_text) >= 20""", "windows")
cte("status", f"""
    SELECT doc_id AS document_id, lang AS portfolio_id,
      'note' || doc_id || CASE lang WHEN 'de' THEN '.TXT' WHEN 'fr' THEN '.csv' WHEN 'es' THEN '' ELSE '.txt' END AS filename,
      CASE WHEN lang = 'fr' THEN 'failed:unsupported_extension:csv'
        WHEN lang = 'es' THEN 'failed:unsupported_extension:note' || doc_id
        WHEN regexp_replace(text, '{SPACES}', '', 'g') = '' THEN 'failed:empty_text'
        WHEN coalesce(n, 0) = 0 THEN 'failed:no_usable_chunks' ELSE 'complete' END AS embedding_status,
      CASE WHEN lang IN ('fr', 'es') THEN 0 ELSE coalesce(n, 0) END AS chunk_count
    FROM documents LEFT JOIN (SELECT document_id, count(*) AS n FROM chunk GROUP BY 1) ON document_id = doc_id""", "chunk")
cte("match", """
    SELECT * FROM (
      SELECT question_id, q.portfolio_id, chunk_id, similarity, q.top_k, document_id, coalesce(chunk_text, '') AS chunk_text,
        row_number() OVER (PARTITION BY question_id ORDER BY round(similarity, 12) DESC, chunk_id) AS position
      FROM (SELECT a.vec_id AS question_id, b.label AS portfolio_id, b.vec_id AS chunk_id, a.vec_id % 5 + 1 AS top_k,
          list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity,
          CASE WHEN a.vec_id % 2 = 0 THEN 0.3 ELSE 0.25 END AS threshold
        FROM embeddings a JOIN embeddings b
          ON b.label = CASE WHEN a.vec_id % 2 = 0 THEN a.label ELSE (a.label + 1) % 10 END) q
      LEFT JOIN (SELECT doc_id AS document_id, text AS chunk_text FROM documents) ON document_id = chunk_id
      WHERE similarity >= threshold) WHERE position <= top_k""")
UUID = "regexp_replace(md5(CAST(conv_id AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"

# --- mutations -------------------------------------------------------------------------
cte("change", """
    SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_id,
      CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, c_mktsegment AS portfolio_id,
      CASE WHEN event_type IN ('purchase', 'error') THEN CAST(user_id AS VARCHAR) END AS project_id,
      'PRJ' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(9, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') AS project_id_external, event_type AS project_name,
      value * CASE WHEN event_id % 89 = 0 THEN -1e6 ELSE 1e6 END AS contract_value_usd,
      CASE WHEN event_id % 97 = 0 THEN 'Paused' ELSE 'In Progress' END AS final_status, value AS delay_days, floor(value) AS subcontractor_count, CAST(ts AS DATE) AS start_date,
      CASE WHEN event_type = 'view' THEN 30 ELSE 7 END AS actual_duration_days
    FROM events JOIN customer ON user_id = c_custkey""")
cte("resolved", """
    SELECT c.*, coalesce(a.project_id, b.project_id)::VARCHAR AS found, coalesce(a.portfolio_id, b.portfolio_id) AS home
    FROM change c
    LEFT JOIN proj a ON c.project_id IS NOT NULL AND CAST(a.project_id AS VARCHAR) = c.project_id
    LEFT JOIN proj b ON c.project_id IS NULL AND b.portfolio_id = c.portfolio_id AND b.project_id_external = c.project_id_external""",
    "change", "proj")
cte("judged", """
    SELECT r.*, gone_at, seq > gone_at IS TRUE AS after_delete,
      CASE WHEN op = 'upsert' AND contract_value_usd < 0 THEN 'negative:contract_value_usd'
        WHEN op = 'upsert' AND final_status = 'Paused' THEN 'bad_status'
        WHEN (project_id IS NOT NULL AND r.found IS NULL) OR (project_id IS NULL AND op = 'delete') THEN 'project not found'
        WHEN project_id IS NOT NULL AND home <> portfolio_id THEN 'project belongs to a different portfolio'
        WHEN project_id IS NOT NULL AND seq > gone_at THEN 'project not found' END AS error
    FROM resolved r LEFT JOIN (SELECT found, min(seq) AS gone_at FROM resolved
      WHERE op = 'delete' AND project_id IS NOT NULL AND home = portfolio_id GROUP BY found) d ON r.found = d.found""", "resolved")
cte("kept", """
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY target ORDER BY seq DESC) AS newest FROM (
        SELECT *, CASE WHEN found IS NULL OR after_delete THEN regexp_replace(md5(portfolio_id || chr(1) || project_id_external),
            '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') ELSE found END AS target
        FROM judged WHERE error IS NULL AND op = 'upsert' AND (found IS NULL OR gone_at IS NULL OR after_delete)))
    WHERE newest = 1""", "judged")
cte("merged", """
    SELECT portfolio_id, CAST(project_id AS VARCHAR) AS project_id, project_id_external, project_name, project_type, region,
      contract_value_usd, subcontractor_count, delay_days, cost_overrun_pct, safety_incidents, payment_disputes, final_status,
      actual_duration_days, 'csv' AS source
    FROM proj WHERE CAST(project_id AS VARCHAR) NOT IN (SELECT target FROM kept)
      AND CAST(project_id AS VARCHAR) NOT IN (SELECT found FROM judged WHERE error IS NULL AND op = 'delete')
    UNION ALL SELECT portfolio_id, target, project_id_external, project_name, NULL, NULL, contract_value_usd,
      subcontractor_count, delay_days, NULL, NULL, NULL, 'In Progress', actual_duration_days,
      CASE WHEN target = found THEN 'csv' ELSE 'manual' END FROM kept""", "kept", "proj")
# The risk statements once more, over the changed table.
for _name in ["by_type", "by_region", "tops", "sub", "score"]:
    _body = CTES[_name]
    for _old in ["by_type", "by_region", "tops"]:
        _body = _body.replace(f"JOIN {_old} ", f"JOIN {_old}_after ")
    _body = _body.replace("FROM proj", "FROM merged").replace("FROM sub", "FROM sub_after")
    _needs = {"sub": ["by_type_after", "by_region_after", "tops_after"], "score": ["sub_after"]}.get(_name, ["merged"])
    cte(f"{_name}_after", _body, *_needs)

# --- models ----------------------------------------------------------------------------
cte("usable", """
    SELECT *, coalesce(payment_disputes >= 1, false) AS label,
      project_type IS NOT NULL AND region IS NOT NULL AND contract_value_usd IS NOT NULL AND subcontractor_count IS NOT NULL AS bid_ok,
      delay_days IS NOT NULL AND cost_overrun_pct IS NOT NULL AND safety_incidents IS NOT NULL AND actual_duration_days IS NOT NULL AS late_ok
    FROM proj WHERE final_status = 'Completed'""", "proj")


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    # screening
    out["n1_encode_history"] = sql("SELECT project_id, round(log_value, 6) AS log_value, subs, type_key, region_key, delay_days FROM feat", "feat")
    out["n2_encode_bids"] = sql("SELECT bid_id, portfolio_id, k, round(lb, 6) AS bid_log_value, sb AS bid_subs, round(nb, 6) AS bid_norm FROM asked", "asked")
    out["n3_distance"] = sql(f"""
        SELECT bid_id, f.project_id, round({DISTANCE}, 6) AS distance FROM asked a
        JOIN orders ON o_custkey = bid_id JOIN feat f ON f.project_id = o_orderkey AND f.portfolio_id = a.portfolio_id""", "asked", "feat")
    out["n4_nearest"] = sql("SELECT bid_id, position, project_id, round(distance, 6) AS distance FROM near", "near")
    out["n4_rejected_bids"] = sql("""
        SELECT c_custkey AS bid_id, CASE WHEN c_acctbal < 0 THEN 'UNASSIGNED' ELSE c_mktsegment END AS portfolio_id,
          CAST(coalesce(n, 5) - 6 AS INTEGER) AS k, 'k must be between 1 and 20' AS error
        FROM cust LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
        WHERE coalesce(n, 5) - 6 NOT BETWEEN 1 AND 20""", "cust")
    ranges = []
    for o in ["delay_days", "cost_overrun_pct", "safety_incidents"]:
        quartiles = ", ".join(f"round(quantile_cont({o}, {p}), 6) AS {a}" for p, a in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
        ranges.append(f"SELECT b.bid_id, '{o}' AS outcome, {quartiles}, count({o}) AS n, {confidence(f'count({o})')} AS confidence "
                      "FROM bid b LEFT JOIN near USING (bid_id) GROUP BY b.bid_id")
    out["n5_outcome_ranges"] = sql(" UNION ALL ".join(ranges), "near")
    low, high = wilson("x", "n")
    out["n6_dispute_rate"] = sql(f"""
        SELECT bid_id, round(x / CAST(nullif(n, 0) AS DOUBLE), 6) AS rate, round({low}, 6) AS ci_low, round({high}, 6) AS ci_high, n,
          {confidence('n')} AS confidence
        FROM (SELECT b.bid_id, count(payment_disputes) AS n, count(*) FILTER (WHERE payment_disputes >= 1) AS x
          FROM bid b LEFT JOIN near USING (bid_id) GROUP BY b.bid_id)""", "near")
    out["n7_caveats"] = sql("""
        SELECT bid_id, CASE WHEN n = 0 THEN 'No similar projects in this portfolio — no cohort to draw from.'
          WHEN n < 5 THEN 'n<5 cohort (n=' || n || ') — treat ranges as directional, not predictive.' ELSE '' END AS caveats
        FROM (SELECT b.bid_id, count(project_id) AS n FROM bid b LEFT JOIN near USING (bid_id) GROUP BY b.bid_id)""", "near")
    out["n8_screening"] = sql("""
        SELECT b.bid_id, b.portfolio_id, count(project_id) AS cohort_size, b.k AS k_requested,
          coalesce(string_agg(CAST(project_id AS VARCHAR), ',' ORDER BY position), '') AS similar_project_ids
        FROM bid b LEFT JOIN near n USING (bid_id) GROUP BY b.bid_id, b.portfolio_id, b.k""", "near")
    out["n9_similar_details"] = sql("SELECT bid_id, position, project_id, project_id_external, project_name, delay_days, cost_overrun_pct FROM near", "near")
    # models
    # every portfolio has its clusters, settled, with no row clearly nearer to another
    out["g4_cluster_checks"] = sql("""
        SELECT portfolio_id, n AS n_rows, CASE WHEN n < 4 THEN 1 ELSE greatest(2, least(3, n // 3)) END AS n_clusters,
          CAST(0 AS BIGINT) AS n_misplaced, CASE WHEN n >= 4 THEN true END AS converged
        FROM (SELECT portfolio_id, count(*) AS n FROM proj GROUP BY portfolio_id)""", "proj")
    out["m1_training_status"] = sql("""
        SELECT *, CASE WHEN n_completed < 5 OR n_usable < 5 THEN 'insufficient' WHEN n_positive IN (0, n_usable) THEN 'single_class' ELSE 'ok' END AS status
        FROM (SELECT p.portfolio_id, count(u.project_id) AS n_completed, count(*) FILTER (WHERE bid_ok AND late_ok) AS n_usable,
            count(*) FILTER (WHERE bid_ok AND late_ok AND label) AS n_positive
          FROM proj p LEFT JOIN usable u USING (project_id) GROUP BY p.portfolio_id)""", "usable")
    out["m2_label"] = sql("SELECT project_id, CAST(CASE WHEN payment_disputes >= 1 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM proj", "proj")
    entries = {"'contract_value_usd'": "contract_value_usd", "'subcontractor_count'": "subcontractor_count",
               "'project_type_' || project_type": "1", "'region_' || region": "1"}
    out["m3_encoded"] = sql(" UNION ALL ".join(
        f"SELECT portfolio_id, project_id, {name} AS feature, round({value}, 2) AS value FROM usable WHERE bid_ok" for name, value in entries.items()), "usable")
    out["m3_feature_names"] = sql("""
        SELECT portfolio_id, 'contract_value_usd,subcontractor_count,delay_days,cost_overrun_pct,safety_incidents,actual_duration_days,'
          || string_agg(name, ',' ORDER BY block, name) AS features_used
        FROM (SELECT DISTINCT portfolio_id, 0 AS block, 'project_type_' || project_type AS name FROM usable WHERE bid_ok AND late_ok
          UNION SELECT DISTINCT portfolio_id, 1, 'region_' || region FROM usable WHERE bid_ok AND late_ok) GROUP BY portfolio_id""", "usable")
    out["m7_stored_runs"] = sql("""
        SELECT portfolio_id, model_type, CASE model_type WHEN 'naive' THEN n_naive ELSE n_honest END AS n_training_samples, n_completed, CAST(4 AS INTEGER) AS versions
        FROM (SELECT p.portfolio_id, count(u.project_id) AS n_completed, count(*) FILTER (WHERE bid_ok AND late_ok) AS n_naive, count(*) FILTER (WHERE bid_ok) AS n_honest
              FROM proj p LEFT JOIN usable u USING (project_id) WHERE p.portfolio_id <> 'MACHINERY' GROUP BY p.portfolio_id),
             (VALUES ('naive'), ('pre_construction')) kinds(model_type)
        WHERE n_completed >= 5 AND CASE model_type WHEN 'naive' THEN n_naive ELSE n_honest END >= 5""", "usable")
    out["m10_trainable"] = sql("""
        SELECT portfolio_id, n AS n_completed, n >= 5 AS trainable FROM (
          SELECT portfolio_id, count(*) FILTER (WHERE final_status = 'Completed') AS n FROM proj GROUP BY portfolio_id)""", "proj")
    # documents and retrieval
    digest = "document_id, portfolio_id, chunk_index, length(chunk_text) AS n_chars, md5(chunk_text) AS digest"
    out["r1_chunk_text"] = sql("SELECT document_id, chunk_index, length(chunk_text) AS n_chars, md5(chunk_text) AS digest FROM chunk", "chunk")
    out["r2_chunk_table"] = sql(f"SELECT {digest} FROM chunk", "chunk")
    out["r5_reindex"] = sql(f"SELECT {digest} FROM chunk", "chunk")
    out["s5_document_intake"] = out["r5_reindex"]
    out["u5_cascade"] = sql(f"SELECT {digest} FROM chunk WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "chunk")
    out["r4_top_matches"] = sql("SELECT question_id, portfolio_id, chunk_id, round(similarity, 6) AS similarity, position FROM match", "match")
    out["r6_checked_questions"] = sql(f"""
        SELECT conv_id, turn, {UUID} AS portfolio_id,
          CASE WHEN turn IN (0, 2) THEN 3 ELSE greatest(1, least(20, conv_id - 5)) END AS top_k,
          CAST(CASE WHEN turn = 0 THEN 0.5 WHEN turn = 2 THEN 0.25 ELSE 1.0 END AS DOUBLE) AS threshold
        FROM conversations WHERE role NOT IN ('system', 'assistant') AND regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g') <> ''""")
    out["r6_rejected_questions"] = sql(f"""
        SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'portfolio_id must be a UUID' ELSE 'question must be a non-empty string' END AS error
        FROM conversations WHERE role IN ('system', 'assistant') OR regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g') = ''""")
    out["r7_source_rows"] = sql("""
        SELECT question_id, position, chunk_id, round(similarity, 6) AS similarity, md5(left(chunk_text, 200)) AS preview,
          CASE lang WHEN 'de' THEN 'note' || doc_id || '.TXT' WHEN 'en' THEN 'note' || doc_id || '.txt' ELSE 'unknown' END AS document_filename
        FROM match LEFT JOIN documents ON doc_id = document_id""", "match")
    out["r8_context_text"] = sql("""
        SELECT question_id, md5('Excerpts:' || chr(10) || string_agg('[C' || position || '] ' || chunk_text, chr(10) || chr(10) ORDER BY position)
          || chr(10) || chr(10) || 'Question: What about item ' || question_id || '?') AS digest
        FROM match GROUP BY question_id""", "match")
    out["r9_confidence"] = sql("""
        SELECT vec_id AS question_id, round(top, 6) AS top_similarity,
          CASE WHEN top IS NULL THEN 'low' WHEN top >= 0.7 THEN 'high' ELSE 'medium' END AS confidence
        FROM embeddings LEFT JOIN (SELECT question_id, max(similarity) AS top FROM match GROUP BY 1) ON question_id = vec_id""", "match")
    out["r10_citations"] = sql("""
        SELECT conv_id, turn, mark - 1 AS mark, CAST(marks[mark] AS INTEGER) AS cited FROM (
          SELECT conv_id, turn, marks, unnest(range(1, len(marks) + 1)) AS mark FROM (
            SELECT conv_id, turn, regexp_extract_all('[C' || turn || '] ' || text || ' [C2] [C0] [Cx] [C99]', '\\[C(\\d+)\\]', 1) AS marks FROM conversations))
        WHERE CAST(marks[mark] AS BIGINT) BETWEEN 1 AND 4""")
    out["r11_status"] = sql("""
        SELECT doc_id, CASE lang WHEN 'en' THEN 'complete' WHEN 'de' THEN 'failed' WHEN 'fr' THEN 'failed' ELSE 'pending' END AS status,
          CASE WHEN lang = 'de' THEN source END AS reason FROM documents""")
    out["r12_index_ready"] = sql("SELECT portfolio_id, bool_or(embedding_status = 'complete') AS ready FROM status GROUP BY portfolio_id", "status")
    # sources and sinks
    out["s1_project_files"] = sql("""
        SELECT portfolio_id, project_id_external AS project_id, project_name, project_type, CAST(start_date AS VARCHAR) AS start_date,
          CAST(end_date AS VARCHAR) AS end_date, region, CAST(subcontractor_count AS VARCHAR) AS subcontractor_count,
          CAST(safety_incidents AS VARCHAR) AS safety_incidents, final_status FROM proj""", "proj")
    out["s2_stored_projects"] = sql("""
        SELECT portfolio_id, CAST(project_id AS VARCHAR) AS project_id, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS INTEGER) AS payment_disputes,
          CAST(NULL AS VARCHAR) AS source, delay_days, start_date, array_to_string(anomaly_flags, ',') AS anomaly_flags
        FROM stored WHERE portfolio_id IN ('BUILDING', 'MACHINERY')""", "stored")
    out["s3_replace_portfolios"] = sql("""
        SELECT portfolio_id, project_id, final_status FROM proj
        WHERE portfolio_id NOT IN ('BUILDING', 'MACHINERY') OR (portfolio_id = 'MACHINERY' AND final_status = 'Completed')""", "proj")
    out["s3_versioned_store"] = sql("""
        SELECT portfolio_id, n_before, n AS n_projects, n AS n_scores, n AS n_places FROM (
          SELECT portfolio_id, count(*) AS n_before, CASE portfolio_id WHEN 'BUILDING' THEN 0
            WHEN 'MACHINERY' THEN count(*) FILTER (WHERE final_status = 'Completed') ELSE count(*) END AS n
          FROM proj GROUP BY portfolio_id)""", "proj")
    out["s4_document_status"] = sql("SELECT document_id, filename, embedding_status, chunk_count FROM status", "status")
    out["s4_document_files"] = sql(f"""
        SELECT doc_id AS document_id, CASE WHEN regexp_replace(text, '{SPACES}', '', 'g') = '' THEN 'failed:empty_text'
          WHEN coalesce(n, 0) = 0 THEN 'failed:no_usable_chunks' ELSE 'complete' END AS embedding_status, coalesce(n, 0) AS chunk_count
        FROM documents LEFT JOIN (SELECT document_id, count(*) AS n FROM chunk GROUP BY 1) ON document_id = doc_id""", "chunk")
    out["s6_integer_safe"] = sql("""
        SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS subcontractor_count,
          CASE WHEN l_returnflag <> 'R' THEN CAST(round_even(l_quantity / 4, 0) AS INTEGER) END AS safety_incidents,
          CASE WHEN l_returnflag <> 'R' THEN l_tax END AS delay_days, CAST(l_shipdate AS DATE) AS start_date FROM lineitem""")
    # mutations
    out["u1_upsert"] = sql("""
        SELECT portfolio_id, project_id, project_id_external, project_name, round(contract_value_usd, 2) AS contract_value_usd,
          round(delay_days, 2) AS delay_days, final_status, actual_duration_days, source FROM merged""", "merged")
    out["u6_stream_changes"] = out["u1_upsert"]
    out["u1_rejected"] = sql("SELECT event_id, op, project_id, error FROM judged WHERE error IS NOT NULL", "judged")
    out["u2_delete"] = sql("""
        SELECT portfolio_id, CAST(project_id AS VARCHAR) AS project_id FROM proj p WHERE NOT EXISTS (
          SELECT 1 FROM change c WHERE op = 'delete' AND c.portfolio_id = p.portfolio_id AND c.project_id = CAST(p.project_id AS VARCHAR))""", "change", "proj")
    out["u3_refresh"] = sql("SELECT portfolio_id, project_id, score, top_driver FROM score_after", "score_after")
    out["u4_analyze"] = sql("""
        SELECT portfolio_id, n_segments, n_segments AS n_scores, n_rules FROM (SELECT portfolio_id, count(*) AS n_segments FROM proj GROUP BY 1)
        JOIN (SELECT portfolio_id, count(*) AS n_rules FROM rule GROUP BY 1) USING (portfolio_id)
        UNION ALL SELECT n_name, 0, 0, 0 FROM nation""", "proj", "rule")
    return out
