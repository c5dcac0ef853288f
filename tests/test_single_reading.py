"""What is costly to compute is computed once, however often it is read."""

import pandas as pd
import pytest
from conftest import project_frame
from pyspark.sql import functions as F

from sitelight.operators import cleaning, clustering, models
from sitelight.plans import catalog_more
from sitelight.sources import marts


@pytest.fixture
def counted(spark):
    """(frame that counts the rows it makes, the counter)."""
    seen = spark.sparkContext.accumulator(0)
    rows = [{"contract_value_usd": 1e6 * (i + 1), "subcontractor_count": i % 5, "delay_days": float(i % 7), "payment_disputes": i % 2} for i in range(24)]
    frame = project_frame(spark, [*rows[:-1], {"delay_days": None}])

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield pd.DataFrame(batch)

    return frame.mapInPandas(count, frame.schema), seen


def test_imputation(counted):
    frame, seen = counted
    filled = cleaning.impute_medians(frame).where("project_id = 'id023'").first()
    assert filled.delay_days == 3.0
    assert seen.value == 24


def test_imputation_report(counted):
    frame, seen = counted
    assert [(r.column, r.n_filled, r.value) for r in cleaning.imputation_report(frame).collect()] == [("delay_days", 1, 3.0)]
    assert seen.value == 24


def test_misplaced_rows(counted):
    frame, seen = counted
    clusters = frame.sparkSession.range(24).select(
        F.lit("p").alias("portfolio_id"), F.format_string("id%03d", "id").alias("project_id"), (F.col("id") % 2).cast("int").alias("cluster_id")
    )
    found = clustering.misplaced(frame, clusters).first()
    assert (found.n_rows, found.n_clusters) == (24, 2)
    assert seen.value == 24


def test_model_runs(counted):
    frame, seen = counted
    runs = models.model_runs(frame).select("model_type", "n_training_samples").collect()
    assert {r.model_type: r.n_training_samples for r in runs} == {models.NAIVE: 23, models.PRE_CONSTRUCTION: 24}
    assert seen.value == 24


def test_similar_details(counted, monkeypatch):
    frame, seen = counted
    bids = frame.sparkSession.createDataFrame(
        [(1, "p", "Commercial", "Northeast", 3e6, 2, 4), (2, "empty", None, None, 1e6, 1, 1)],
        "bid_id long, portfolio_id string, project_type string, region string, contract_value_usd double, subcontractor_count int, k int",
    )
    monkeypatch.setattr(marts, "projects", lambda *_: frame)
    monkeypatch.setattr(marts, "bids", lambda *_: bids)
    details = catalog_more.n9_similar_details(frame.sparkSession, "")
    found = sorted((r.position, r.project_id, r.project_id_external, r.project_name) for r in details.collect())
    assert [f[0] for f in found] == [1, 2, 3, 4] and all((f[2], f[3]) == (f"x{f[1][2:]}", f"n{int(f[1][2:])}") for f in found)
    assert seen.value == 24  # 48 before


def test_lines_shuffle_once(spark, tmp_path):
    tables = {
        "lineitem": "select 1L l_orderkey, 2L l_partkey, 3L l_suppkey, 1 l_linenumber, 4D l_quantity, 5D l_extendedprice, 0.06D l_discount, 0D l_tax, 'R' l_returnflag, 'O' l_linestatus, timestamp'1996-01-02' l_shipdate",
        "orders": "select 1L o_orderkey, 7L o_custkey, 'F' o_orderstatus, 9D o_totalprice, timestamp'1996-01-01' o_orderdate, '1-URGENT' o_orderpriority",
        "customer": "select 7L c_custkey, 'c' c_name, 0 c_nationkey, 1D c_acctbal, 'BUILDING' c_mktsegment",
        "nation": "select 0 n_nationkey, 'n' n_name, 0 n_regionkey",
        "region": "select 0 r_regionkey, 'r' r_name",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    projects = marts.measured_projects(spark, str(tmp_path))
    plan = projects._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    row = projects.first()
    assert (row.subcontractor_count, row.delay_days, row.cost_overrun_pct, row.safety_incidents, row.payment_disputes) == (1, 4.0, 6.0, 1, 0)
