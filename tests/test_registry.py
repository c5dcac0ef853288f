"""The registered queries keep their SQL; a few are run against it here, all of
them by compare.py."""

import pytest

import __spark_entry__ as entry
import compare
from sitelight.functions.joins import released
from sitelight.plans import catalog

SF = "/root/testdata/sf0.001"
WITHOUT_SQL = {
    "g4_cluster_ids", "m4_naive_model", "m5_pre_construction_model", "m7_model_runs", "m8_importance_share",
    "m9_leakage_gap", "r3_encode", "r4_text_search", "r4_search_report", "r13_index_project_files",
}


def test_every_query_has_its_sql():
    assert set(catalog.queries()) - set(entry.oracle_sql()) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["c12_clean", "k9_scores", "d8_top_signals", "q4_riskiest", "n4_nearest", "r2_chunk_table", "r4_top_matches", "u1_upsert"])
def test_query_equals_sql(spark, name):
    verdict, _, fine = compare.compare(spark, compare.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert fine, verdict


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 25 and {r.position for r in rows} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("name", ["c12_clean", "k9_scores", "n8_screening", "r4_top_matches", "u3_refresh"])
def test_queries_leave_no_cached_tables(spark, name):
    kept = lambda: {int(k) for k in spark.sparkContext._jsc.getPersistentRDDs().keySet()}
    before = kept()
    with released():
        assert entry.queries()[name](spark, SF).count() > 0
    assert kept() <= before
