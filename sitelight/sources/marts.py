"""The star-schema tables seen as project-history tables.

One order becomes one project, its line items supply the measures, the
customer supplies portfolio and region. Also derived here: bids (one per
customer), documents, questions and project mutations (from the event log).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelight import schema as S
from sitelight.operators.cleaning import flag_anomalies


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files, be it one file or a folder of them.

    A file stream takes a plain path for a folder; as a pattern the path may name either."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def external_id(key: Column) -> Column:
    """At least nine digits; longer keys stay whole, so that no two are alike."""
    text = key.cast("string")
    return F.concat(F.lit("PRJ"), F.when(F.length(text) >= 9, text).otherwise(F.lpad(text, 9, "0")))


def measured_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects before imputation: orders without line items have null measures.

    The lines of an order meet once: suppliers are told apart, lines summed and
    orders joined where one shuffle by order has put them."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
        .repartition("l_orderkey")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.max("l_shipdate").alias("last_ship"),
            F.count_distinct("l_suppkey").cast("int").alias("subcontractor_count"),
            F.sum("l_quantity").alias("delay_days"),
            F.sum(F.round(F.col("l_discount") * 100)).alias("cost_overrun_pct"),
            F.count_if(F.col("l_returnflag") == "R").cast("int").alias("safety_incidents"),
            F.count_if((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"))
            .cast("int")
            .alias("payment_disputes"),
        )
    )
    done = F.col("o_orderstatus") == "F"
    return (
        table(spark, sf_dir, "orders")
        .join(lines, "o_orderkey", "left")
        .join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("c_mktsegment").alias("portfolio_id"),
            F.col("o_orderkey").alias("project_id"),
            external_id(F.col("o_orderkey")).alias("project_id_external"),
            F.col("c_name").alias("project_name"),
            F.col("o_orderpriority").alias("project_type"),
            (F.col("o_totalprice") * 200).alias("contract_value_usd"),
            F.to_date("o_orderdate").alias("start_date"),
            F.when(done, F.to_date("last_ship")).alias("end_date"),
            F.col("r_name").alias("region"),
            "subcontractor_count",
            "delay_days",
            "cost_overrun_pct",
            "safety_incidents",
            "payment_disputes",
            F.when(done, S.COMPLETED).otherwise(S.IN_PROGRESS).alias("final_status"),
            F.when(done, F.datediff("last_ship", "o_orderdate")).alias("actual_duration_days"),
        )
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    customer = table(spark, sf_dir, "customer")
    return customer.join(places, customer.c_nationkey == places.n_nationkey, "left").select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_name", "r_name"
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored projects: measures as they are, flags attached, all from CSV."""
    return flag_anomalies(measured_projects(spark, sf_dir))


def raw_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as they would stand in an uploaded file: all text, blanks
    as null. A few keys are blank, and a few repeat the key of the order ten
    before, in the same portfolio or in another (the first of a portfolio wins)."""
    typed = measured_projects(spark, sf_dir)
    order = F.col("project_id")
    key = F.when(order % 97 == 0, None).when(order % 10 == 3, external_id(order - 10)).otherwise(external_id(order))
    return typed.select(
        "portfolio_id",
        F.struct(order.alias("row")).alias("_ord"),
        key.alias("project_id"),
        *[F.col(c).cast("string").alias(c) for c in S.REQUIRED_COLUMNS if c != "project_id"],
    )


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposed bid per customer, shaped by their latest order; customers
    in debt bid into a portfolio without history."""
    latest = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("project_type"),
            F.count(F.lit(1)).cast("int").alias("subcontractor_count"),
        )
    )
    return customers(spark, sf_dir).join(latest, "c_custkey", "left").select(
        F.col("c_custkey").alias("bid_id"),
        F.when(F.col("c_acctbal") < 0, "UNASSIGNED").otherwise(F.col("c_mktsegment")).alias("portfolio_id"),
        "project_type",
        F.col("r_name").alias("region"),
        (F.col("c_acctbal") * 10000).alias("contract_value_usd"),
        "subcontractor_count",
        F.greatest(F.lit(1), F.least(F.lit(20), F.coalesce("subcontractor_count", F.lit(5)))).alias("k"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads: language is the portfolio; the file name's
    extension differs by language, so that some are not readable."""
    lang = F.col("lang")
    suffix = F.when(lang == "de", ".TXT").when(lang == "fr", ".csv").when(lang == "es", "").otherwise(".txt")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        lang.alias("portfolio_id"),
        F.concat(F.lit("note"), F.col("doc_id").cast("string"), suffix).alias("filename"),
        "text",
    )


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents, all with a readable name."""
    return documents(spark, sf_dir).withColumn("filename", F.concat("filename", F.lit(".txt")))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given vectors as chunks; the text is the document of the same number."""
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("chunk_text")
    )
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("portfolio_id"), "embedding"
    )
    return vectors.join(texts, "chunk_id", "left").fillna("", ["chunk_text"])


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks once: even ones in their own portfolio (and find
    themselves), odd ones in the next. The numbers asked for differ."""
    own = F.col("vec_id") % 2 == 0
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("question_id"),
        F.when(own, F.col("label")).otherwise((F.col("label") + 1) % 10).cast("int").alias("portfolio_id"),
        F.concat(F.lit("What about item "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"),
        "embedding",
        (F.col("vec_id") % 5 + 1).cast("int").alias("top_k"),
        F.when(own, 0.3).otherwise(0.25).alias("threshold"),
    )


def mutations(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Event log as project changes: ``error`` deletes, ``purchase`` addresses
    a row by id, the rest by external id inside the customer's portfolio. Some
    have a negative value or an unknown status."""
    events = table(spark, sf_dir, "events") if events is None else events
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    by_id = F.col("event_type").isin("purchase", "error")
    return events.join(customer, F.col("user_id") == F.col("c_custkey")).select(
        F.struct("ts", "event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.col("c_mktsegment").alias("portfolio_id"),
        F.when(by_id, F.col("user_id").cast("string")).alias("project_id"),
        external_id(F.col("user_id")).alias("project_id_external"),
        F.col("event_type").alias("project_name"),
        F.lit(None).cast("string").alias("project_type"),
        (F.col("value") * F.when(F.col("event_id") % 89 == 0, -1e6).otherwise(1e6)).alias("contract_value_usd"),
        F.to_date("ts").alias("start_date"),
        F.when(F.col("event_type") == "view", F.date_add(F.to_date("ts"), 30)).alias("end_date"),
        F.lit(None).cast("string").alias("region"),
        F.floor("value").cast("int").alias("subcontractor_count"),
        F.col("value").alias("delay_days"),
        F.lit(None).cast("double").alias("cost_overrun_pct"),
        F.lit(None).cast("int").alias("safety_incidents"),
        F.lit(None).cast("int").alias("payment_disputes"),
        F.when(F.col("event_id") % 97 == 0, "Paused").otherwise(S.IN_PROGRESS).alias("final_status"),
        F.lit(7).alias("actual_duration_days"),
        F.array().cast("array<string>").alias("anomaly_flags"),
    )
