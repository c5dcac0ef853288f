"""Registered queries: screening, models, retrieval, mutations, sources, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelight import schema as S
from sitelight.functions.text import chunk_words
from sitelight.operators import clustering, models, mutations, retrieval, retrieval_index, screening
from sitelight.operators.segments import feature_medians
from sitelight.plans import analyze
from sitelight.plans.common import joined, rounded
from sitelight.session import materialize, scratch_table
from sitelight.sources import document_files, marts, project_files, tables
from sitelight.sources.store import Store
from sitelight.streaming import changes, intake


# --- clusters -----------------------------------------------------------------------
def g4_cluster_ids(spark, sf):
    return clustering.assign_clusters(marts.projects(spark, sf))


def g4_cluster_checks(spark, sf):
    """Clusters per portfolio, whether they settled, and rows that are clearly
    nearer to another cluster's mean."""
    projects = materialize(marts.projects(spark, sf).select(*clustering.SOURCE), "projects")
    clusters, report = clustering.fit_clusters(projects)
    found = clustering.misplaced(projects, materialize(clusters, "clusters"))
    return found.join(report.select("portfolio_id", "converged"), "portfolio_id", "left")


# --- screening ------------------------------------------------------------------------
def n1_encode_history(spark, sf):
    encoded = screening.encode_history(marts.projects(spark, sf))
    return rounded(encoded.select("project_id", "log_value", "subs", "type_key", "region_key", "delay_days"))


def n2_encode_bids(spark, sf):
    history = marts.projects(spark, sf)
    medians = feature_medians(history)
    categories = screening.encode_history(history, medians=medians).select("portfolio_id", "type_key", "region_key").distinct()
    asked = screening.encode_bids(marts.bids(spark, sf), medians, categories)
    return rounded(asked.select("bid_id", "portfolio_id", "k", "bid_log_value", "bid_subs", "bid_norm"))


def _cohort(spark, sf):
    return screening.nearest(marts.bids(spark, sf), marts.projects(spark, sf))


def n3_distance(spark, sf):
    """Distance of each bid to the past projects of the same customer."""
    history = marts.projects(spark, sf)
    medians = feature_medians(history)
    encoded = screening.encode_history(history, medians=medians)
    categories = encoded.select("portfolio_id", "type_key", "region_key").distinct()
    asked = screening.encode_bids(marts.bids(spark, sf), medians, categories)
    own = marts.table(spark, sf, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("bid_id"))
    pairs = encoded.join(own, "project_id").join(asked, ["bid_id", "portfolio_id"]).withColumn("shared", screening.matches())
    return rounded(pairs.select("bid_id", "project_id", screening.distance(F.col("log_value")).alias("distance")))


def n4_nearest(spark, sf):
    return rounded(_cohort(spark, sf).select("bid_id", "position", "project_id", "distance"))


def n4_rejected_bids(spark, sf):
    bids = marts.bids(spark, sf).withColumn("k", F.coalesce("subcontractor_count", F.lit(5)) - 6)
    return screening.rejected_bids(bids)


def _screened(spark, sf):
    return screening.screen(marts.bids(spark, sf), marts.projects(spark, sf))


def n5_outcome_ranges(spark, sf):
    wide = _screened(spark, sf)
    lines = [
        F.struct(
            F.lit(o).alias("outcome"),
            *[F.col(f"outcomes.{o}.{c}").alias(c) for c in ["p25", "p50", "p75", "n", "confidence"]],
        )
        for o in screening.OUTCOME_RANGES
    ]
    return rounded(wide.select("bid_id", F.inline(F.array(*lines))))


def n6_dispute_rate(spark, sf):
    return rounded(_screened(spark, sf).select("bid_id", "outcomes.any_dispute.*"))


def n7_caveats(spark, sf):
    return _screened(spark, sf).select("bid_id", joined("caveats"))


def n8_screening(spark, sf):
    return _screened(spark, sf).select("bid_id", "portfolio_id", "cohort_size", "k_requested", joined("similar_project_ids"))


def n9_similar_details(spark, sf):
    projects = materialize(
        marts.projects(spark, sf).select(*screening.SOURCE, "project_id_external", "project_name"), "projects"
    )
    details = screening.similar_details(screening.nearest(marts.bids(spark, sf), projects, written=True), projects)
    return details.select("bid_id", "position", "project_id", "project_id_external", "project_name", "delay_days", "cost_overrun_pct")


# --- models ----------------------------------------------------------------------------
def m1_training_status(spark, sf):
    projects = marts.projects(spark, sf)
    return models.training_status(projects, models.FEATURES[models.NAIVE])


def m2_label(spark, sf):
    return marts.projects(spark, sf).select("project_id", models.label().alias("label"))


def m3_encoded(spark, sf):
    features = models.FEATURES[models.PRE_CONSTRUCTION]
    return rounded(models.encoded(models.training_rows(marts.projects(spark, sf), features), features), 2)


def m3_feature_names(spark, sf):
    features = models.FEATURES[models.NAIVE]
    names = models.feature_names(models.training_rows(marts.projects(spark, sf), features), features)
    return names.select("portfolio_id", joined("features_used"))


def _report(model_type):
    def query(spark, sf):
        fitted = models.fit(marts.projects(spark, sf), model_type)
        return rounded(fitted.select(
            "portfolio_id", "model_type", "status", "accuracy", joined("features_used"), "n_training_samples",
            F.size("feature_importances").alias("n_importances"),
        ))

    return query


def _runs(spark, sf):
    return models.model_runs(marts.projects(spark, sf))


def m7_model_runs(spark, sf):
    runs = models.latest_runs(_runs(spark, sf))
    return rounded(runs.select("portfolio_id", "model_type", "accuracy", joined("features_used"), "n_training_samples"))


def m7_stored_runs(spark, sf):
    """Runs as the store holds them after Machinery lost its finished projects and
    all were trained again, and how many versions it took."""
    store, projects = scratch_table(spark, "trained"), _table_before(spark, sf)
    analyze.store_projects(projects, store)
    everyone = projects.select("portfolio_id").distinct()
    analyze.train(spark, store, everyone)
    changed = everyone.where("portfolio_id = 'MACHINERY'")
    analyze.store_projects(projects.where("portfolio_id = 'MACHINERY' and final_status <> 'Completed'"), store, changed)
    analyze.train(spark, store, changed)
    kept = Store(spark, store)
    runs = models.latest_runs(kept.read("model_runs")).withColumn("versions", F.lit(len(kept.versions())))
    return runs.select("portfolio_id", "model_type", "n_training_samples", "n_completed", "versions")


def m8_importance_share(spark, sf):
    return rounded(models.importance_share(_runs(spark, sf)))


def m9_leakage_gap(spark, sf):
    return rounded(models.leakage_gap(_runs(spark, sf)))


def m10_trainable(spark, sf):
    return models.trainable(marts.projects(spark, sf))


# --- documents and retrieval -----------------------------------------------------------
def _digest(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "document_id", "portfolio_id", "chunk_index", F.length("chunk_text").alias("n_chars"),
        F.md5("chunk_text").alias("digest"),
    )


def r1_chunk_text(spark, sf):
    documents = marts.table(spark, sf, "documents")
    return documents.select(
        F.col("doc_id").alias("document_id"), F.posexplode(chunk_words(F.col("text"))).alias("chunk_index", "chunk_text")
    ).select("document_id", "chunk_index", F.length("chunk_text").alias("n_chars"), F.md5("chunk_text").alias("digest"))


def r2_chunk_table(spark, sf):
    return _digest(retrieval.chunk_table(marts.text_documents(spark, sf)))


def r3_encode(spark, sf):
    vectors = retrieval.encode(retrieval.chunk_table(marts.text_documents(spark, sf)), "chunk_text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select("document_id", "chunk_index", F.size("embedding").alias("dims"), F.round(norm, 4).alias("norm"))


def _vector_search(spark, sf):
    chunks = marts.vector_chunks(spark, sf)
    return retrieval_index.Search(marts.vector_questions(spark, sf), retrieval_index.build_index(chunks), chunks)


def _matches(spark, sf):
    return _vector_search(spark, sf).matches


def r4_top_matches(spark, sf):
    return rounded(_matches(spark, sf))


def _text_search(spark, sf):
    everything = marts.text_documents(spark, sf).withColumn("portfolio_id", F.lit("all"))
    chunks = retrieval.encode(retrieval.chunk_table(everything), "chunk_text").withColumn(
        "chunk_id", F.concat_ws("-", "document_id", "chunk_index")
    )
    chunks = materialize(chunks.select("chunk_id", "portfolio_id", "embedding"), "encoded-chunks")
    questions = retrieval.encode(
        marts.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.lit("all").alias("portfolio_id"), "text"),
        "text",
    )
    return retrieval_index.Search(questions, retrieval_index.build_index(chunks), chunks, top_k=5, threshold=0.3)


def r4_text_search(spark, sf):
    """Benchmark passages asked of every document chunk, one portfolio."""
    return rounded(_text_search(spark, sf).matches, 4)


def r4_search_report(spark, sf):
    """How much of the two indexes their searches opened."""
    vectors = _vector_search(spark, sf).report().withColumn("portfolio_id", F.col("portfolio_id").cast("string"))
    return rounded(vectors.unionByName(_text_search(spark, sf).report()))


def r5_reindex(spark, sf):
    documents = marts.text_documents(spark, sf)
    chunks = retrieval.encode(retrieval.chunk_table(documents), "chunk_text")
    again = documents.where("portfolio_id = 'de'")
    return _digest(retrieval.reindex(retrieval.reindex(chunks, again), again))


def _asked(spark, sf):
    turns = marts.table(spark, sf, "conversations")
    digest = F.md5(F.col("conv_id").cast("string"))
    uuid = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return turns.select(
        "conv_id", "turn",
        F.when(F.col("role") == "system", digest).otherwise(F.concat(F.lit(" "), uuid)).alias("portfolio_id"),
        F.when(F.col("role") == "assistant", "  ").otherwise(F.col("text")).alias("question"),
        F.when(F.col("turn") == 0, F.lit(None)).when(F.col("turn") == 2, "many")
        .otherwise((F.col("conv_id") - 5).cast("string")).alias("top_k"),
        F.when(F.col("turn") == 0, "").when(F.col("turn") == 2, "0.25").otherwise("7").alias("threshold"),
    )


def r6_checked_questions(spark, sf):
    valid, _ = retrieval.checked_questions(_asked(spark, sf))
    return valid.select("conv_id", "turn", "portfolio_id", "top_k", "threshold")


def r6_rejected_questions(spark, sf):
    _, rejected = retrieval.checked_questions(_asked(spark, sf))
    return rejected.select("conv_id", "turn", "error")


def r7_source_rows(spark, sf):
    names = marts.documents(spark, sf).where("portfolio_id <> 'es'").withColumn(
        "filename", F.when(F.col("portfolio_id") != "fr", F.col("filename"))
    )
    rows = retrieval.source_rows(_matches(spark, sf), marts.vector_chunks(spark, sf), names)
    return rounded(rows.withColumn("preview", F.md5("preview")))


def r8_context_text(spark, sf):
    context = retrieval.context_text(marts.vector_questions(spark, sf), _matches(spark, sf), marts.vector_chunks(spark, sf))
    return context.select("question_id", F.md5("context").alias("digest"))


def r9_confidence(spark, sf):
    return rounded(retrieval.confidence(marts.vector_questions(spark, sf), _matches(spark, sf)))


def r10_citations(spark, sf):
    answers = marts.table(spark, sf, "conversations").withColumn(
        "answer", F.concat(F.lit("[C"), F.col("turn").cast("string"), F.lit("] "), F.col("text"), F.lit(" [C2] [C0] [Cx] [C99]"))
    )
    return retrieval.citations(answers, F.lit(4)).select("conv_id", "turn", "mark", "cited")


def r11_status(spark, sf):
    lang = F.col("lang")
    raw = F.when(lang == "en", "complete").when(lang == "de", F.concat(F.lit("failed:"), F.col("source"))).when(lang == "fr", "failed").otherwise("processing")
    status, reason = retrieval.normalized_status(raw)
    return marts.table(spark, sf, "documents").select("doc_id", status.alias("status"), reason.alias("reason"))


def r12_index_ready(spark, sf):
    return retrieval.index_ready(retrieval.document_status(marts.documents(spark, sf)))


def _project_files(spark, sf) -> str:
    path = scratch_table(spark, "project-files")
    rows = marts.measured_projects(spark, sf)
    (
        rows.withColumn("project_id", F.col("project_id_external"))
        .select("portfolio_id", *S.REQUIRED_COLUMNS)
        .write.option("header", True).option("escape", '"').partitionBy("portfolio_id").csv(path)
    )
    return path


def r13_index_project_files(spark, sf):
    """The raw project files, chunked as text documents."""
    files = document_files.read_document_files(spark, _project_files(spark, sf), r"portfolio_id=([^/]+)/")
    return _digest(retrieval.chunk_table(files.withColumn("filename", F.concat("filename", F.lit(".txt")))))


# --- sources and sinks --------------------------------------------------------------------
def s1_project_files(spark, sf):
    rows = project_files.read_project_files(spark, _project_files(spark, sf) + "/*/*.csv", r"portfolio_id=([^/]+)/")
    return rows.select(
        "portfolio_id", "project_id", "project_name", "project_type", "start_date", "end_date", "region",
        "subcontractor_count", "safety_incidents", "final_status",
    )


def s2_stored_projects(spark, sf):
    path = scratch_table(spark, "stored")
    stored = marts.projects(spark, sf).drop("region", "payment_disputes")
    stored.write.partitionBy("portfolio_id").parquet(path)
    back = tables.read_projects(spark, path, ["BUILDING", "MACHINERY"])
    return back.select("portfolio_id", "project_id", "region", "payment_disputes", "source", "delay_days", "start_date",
                       joined("anomaly_flags"))


def s3_replace_portfolios(spark, sf):
    """Machinery keeps its finished projects only, Building becomes empty."""
    path = scratch_table(spark, "replaced")
    everything = marts.projects(spark, sf).select("portfolio_id", "project_id", "final_status")
    tables.replace_portfolios(everything, path, everything.select("portfolio_id").distinct())
    touched = everything.where("portfolio_id in ('BUILDING', 'MACHINERY')").select("portfolio_id").distinct()
    finished = everything.where("portfolio_id = 'MACHINERY' and final_status = 'Completed'")
    for _ in range(2):
        tables.replace_portfolios(finished, path, touched)
    return spark.read.parquet(path).select("portfolio_id", "project_id", "final_status")


def s3_versioned_store(spark, sf):
    """Machinery keeps its finished projects and Building becomes empty, in all
    tables at once: projects per portfolio in the version before and after, and
    scores and places of ids after."""
    store, everything = scratch_table(spark, "versions"), materialize(_table_before(spark, sf), "everything")
    analyze.store_projects(everything, store, derive=True)
    kept = Store(spark, store)
    before = kept.versions()[-1]
    touched = everything.where("portfolio_id in ('BUILDING', 'MACHINERY')").select("portfolio_id").distinct()
    analyze.store_projects(everything.where("portfolio_id = 'MACHINERY' and final_status = 'Completed'"), store, touched, derive=True)
    count = lambda name, version=None: kept.read(name, version=version).groupBy("portfolio_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    found = count("projects", before).withColumnRenamed("n_projects", "n_before")
    for name in ("projects", "scores", "places"):
        found = found.join(count(name), "portfolio_id", "left").fillna(0, [f"n_{name}"])
    return found


def s4_document_status(spark, sf):
    return retrieval.document_status(marts.documents(spark, sf)).select(
        "document_id", "filename", "embedding_status", "chunk_count"
    )


def s4_document_files(spark, sf):
    """Every document written to a file of its own and read back."""
    path = scratch_table(spark, "document-files")
    document_files.write_text_files(marts.table(spark, sf, "documents").select("text", "doc_id"), path, "doc_id")
    found = document_files.read_document_files(spark, path, r"doc_id=(\d+)[./]", below="*.txt")
    status = retrieval.document_status(found).select(
        F.col("portfolio_id").cast("long").alias("document_id"), "embedding_status", "chunk_count"
    )
    with document_files.small_files(spark):
        return materialize(status, "document-status")


def s5_document_intake(spark, sf):
    stream = marts.table_stream(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("lang").alias("portfolio_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text",
    )
    store = scratch_table(spark, "intake")
    intake.start_intake(stream, store, f"{store}/progress").awaitTermination()
    return _digest(spark.read.parquet(f"{store}/chunks"))


def s6_integer_safe(spark, sf):
    rows = marts.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_quantity") / 2).alias("subcontractor_count"),
        F.when(F.col("l_returnflag") == "R", float("nan")).otherwise(F.col("l_quantity") / 4).alias("safety_incidents"),
        F.when(F.col("l_returnflag") == "R", float("nan")).otherwise(F.col("l_tax")).alias("delay_days"),
        F.col("l_shipdate").alias("start_date"),
    )
    return tables.integer_safe(rows)


# --- mutations ------------------------------------------------------------------------------
def _table_before(spark, sf):
    return tables.conform(marts.projects(spark, sf).withColumn("source", F.lit(S.SOURCE_CSV)))


def _changed_columns(projects: DataFrame) -> DataFrame:
    return rounded(projects.select(
        "portfolio_id", "project_id", "project_id_external", "project_name", "contract_value_usd", "delay_days",
        "final_status", "actual_duration_days", "source",
    ), 2)


def u1_upsert(spark, sf):
    applied = mutations.apply_mutations(_table_before(spark, sf), marts.mutations(spark, sf))
    return _changed_columns(applied.projects)


def u1_rejected(spark, sf):
    applied = mutations.apply_mutations(_table_before(spark, sf), marts.mutations(spark, sf))
    return applied.rejected.select(F.col("seq.event_id").alias("event_id"), "op", "project_id", "error")


def u2_delete(spark, sf):
    requests = marts.mutations(spark, sf).where("op = 'delete'").select(
        "seq", "portfolio_id", "project_id", "project_id_external"
    )
    return mutations.delete_projects(_table_before(spark, sf), requests).projects.select("portfolio_id", "project_id")


def u3_refresh(spark, sf):
    """Store, change, refresh the touched portfolios, read the scores."""
    store = scratch_table(spark, "store")
    before = materialize(_table_before(spark, sf), "before")
    analyze.store_projects(before, store, derive=True)
    applied = mutations.apply_mutations(before, marts.mutations(spark, sf))
    touched = materialize(applied.touched, "touched")
    analyze.store_projects(applied.projects.join(touched, "portfolio_id", "left_semi"), store, touched, derive=True)
    scores = Store(spark, store).read("scores")
    return scores.select("portfolio_id", "project_id", "score", "breakdown.top_driver")


def u4_analyze(spark, sf):
    projects = materialize(marts.projects(spark, sf), "projects")
    empty = marts.table(spark, sf, "nation").select(F.col("n_name").alias("portfolio_id"))
    portfolios = projects.select("portfolio_id").distinct().unionByName(empty)
    return analyze.analysis_counts(analyze.analyze(projects), portfolios)


def u5_cascade(spark, sf):
    toxic = marts.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    chunks = retrieval.chunk_table(marts.text_documents(spark, sf))
    return _digest(mutations.cascade(chunks, toxic, ["document_id"]))


def u6_stream_changes(spark, sf):
    store = scratch_table(spark, "changing")
    analyze.store_projects(_table_before(spark, sf), store)
    log = marts.table_stream(spark, sf, "events")
    changes.start_changes(marts.mutations(spark, sf, log), store, f"{store}/progress").awaitTermination()
    return _changed_columns(analyze.stored_projects(spark, store))


def queries():
    out = {
        f.__name__: f
        for f in [
            g4_cluster_ids, g4_cluster_checks,
            n1_encode_history, n2_encode_bids, n3_distance, n4_nearest, n4_rejected_bids, n5_outcome_ranges, n6_dispute_rate,
            n7_caveats, n8_screening, n9_similar_details,
            m1_training_status, m2_label, m3_encoded, m3_feature_names, m7_model_runs, m7_stored_runs, m8_importance_share,
            m9_leakage_gap, m10_trainable,
            r1_chunk_text, r2_chunk_table, r3_encode, r4_top_matches, r4_text_search, r4_search_report, r5_reindex,
            r6_checked_questions, r6_rejected_questions, r7_source_rows, r8_context_text, r9_confidence,
            r10_citations, r11_status, r12_index_ready, r13_index_project_files,
            s1_project_files, s2_stored_projects, s3_replace_portfolios, s3_versioned_store, s4_document_status, s4_document_files,
            s5_document_intake, s6_integer_safe,
            u1_upsert, u1_rejected, u2_delete, u3_refresh, u4_analyze, u5_cascade, u6_stream_changes,
        ]
    }
    out["m4_naive_model"] = _report(models.NAIVE)
    out["m5_pre_construction_model"] = _report(models.PRE_CONSTRUCTION)
    return out
