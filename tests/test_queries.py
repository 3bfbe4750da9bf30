"""The registry, and a cross-section of queries against their SQL on the smallest tables."""

import pytest

from tests.harness import compare, duck
from tidemark.catalog import load

ROOT = "/root/testdata/sf0.001"
SAMPLE = ("a1_market_breadth", "a2_return_distribution", "a7_capital_flow", "a9_futures_curve", "a12_matched_interest", "c6_adaptive_pool", "d6_evidence_guard", "e11_guard_family", "f1_breadth_features",
          "f7_funding_features", "f10_global_risk_features", "g1_append_only_drift", "g8_admission", "g16_user_sessions", "j4_asof_strict", "j12_validity_interval", "j20_training_window", "m8_non_regression_gate",
          "p2_majority_layout", "r9_validated_accuracy", "s8_snapshot_sink", "t3_top_tenth", "v17_bars_reconcile", "w15_weighted_median_scale", "w24_chained_anchors",
          "e7_selective_sweep", "g14_atomic_publish", "m5_live_statistics", "m13_running_comparison", "p1_alias_resolution", "s9_file_manifest", "s14_lineage_check", "v14_universe_equality", "w11_prior_quantiles")


def test_every_check_names_a_query():
    queries, sql = load()
    assert set(sql) <= set(queries)
    assert len(queries) > 250


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    queries, sql = load()
    verdict = compare(spark, duck(ROOT), ROOT, name, queries[name], sql[name])
    assert verdict.startswith("ok"), verdict


def test_snapshot_refuses_an_existing_target(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from tidemark.sources.scan import write_snapshot

    df = spark.sql("SELECT DATE'2024-01-02' AS trade_date, 1.5D AS x")
    write_snapshot(df, f"{tmp_path}/snap")
    with pytest.raises(AnalysisException):
        write_snapshot(df, f"{tmp_path}/snap")


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "breadth_available" in df.columns
