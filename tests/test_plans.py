"""Plan shape: no registered batch query may contain a cartesian product, a
nested-loop join or a Python UDF evaluation, and scans carry pruned schemas."""

from __future__ import annotations

import contextlib
import io
import os

import pytest

from orderflow.plans.registry import ORACLE, QUERIES

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
SUBSET = ("mart_fraud_daily", "mart_dim_products", "jn_star_fact", "jn_blocklist_anti", "rule_decision",
          "feat_matrix", "drift_ks_wasserstein", "ml_threshold_cost", "graph_neighbor_features",
          "mart_forecast_vs_actuals", "ts_training_windows", "rag_topk_cosine", "jn_velocity_range")
NAMES = sorted(ORACLE) if os.environ.get("ORDERFLOW_FULL_PLANS") else [n for n in SUBSET if n in QUERIES]


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_products(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in text, f"{name} plans a {bad}"


def test_scan_prunes_columns(spark):
    text = plan_text(QUERIES["agg_orders_per_minute"](spark, SF_SMALL))
    assert "ReadSchema: struct<p_partkey:bigint>" in text
    assert "GreaterThanOrEqual(p_partkey" not in text and "LessThanOrEqual(p_partkey" not in text
    # The panel needs only timestamps, so the velocity window is pruned away.
    assert "Window" not in text


def jobs_of(spark, name: str) -> int:
    """Spark jobs that a query runs, building included."""
    group = f"count-{name}"
    spark.sparkContext.setJobGroup(group, name)
    QUERIES[name](spark, SF_SMALL).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_column_of_a_mart_or_of_the_features_runs_only_its_own_jobs(spark):
    assert jobs_of(spark, "rule_value_tier") <= 12 < jobs_of(spark, "mart_dim_users")
    assert jobs_of(spark, "rule_product_risk_tier") <= 12 < jobs_of(spark, "mart_dim_products")
    assert jobs_of(spark, "feat_amount_zscore") <= 30 and jobs_of(spark, "feat_flags") <= 35 < jobs_of(spark, "feat_matrix")
