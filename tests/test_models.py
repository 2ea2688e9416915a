"""Property checks for the rows-only model outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.operators import modeling
from orderflow.plans.registry import QUERIES

from conftest import SF_SMALL


def test_ensemble_probabilities(spark):
    out = QUERIES["ml_stacked_ensemble"](spark, SF_SMALL)
    test_rows = QUERIES["win_chrono_split"](spark, SF_SMALL).filter(F.col("split") == "test")
    agg = out.agg(F.min("fraud_probability").alias("lo"), F.max("fraud_probability").alias("hi"),
                  F.count(F.lit(1)).alias("n"), F.countDistinct("order_id").alias("ids")).first()
    assert 0.0 <= agg.lo <= agg.hi <= 1.0
    assert agg.n == agg.ids == test_rows.count()


def test_registered_ensemble_trains_in_full(spark, monkeypatch):
    seen = []

    def stacked(train, test, cols, effort=modeling.Effort()):
        seen.append(effort)
        return test

    monkeypatch.setattr(modeling, "stacked_ensemble", stacked)
    QUERIES["ml_stacked_ensemble"](spark, SF_SMALL)
    assert seen == [modeling.Effort(boosting_rounds=500, forest_trees=200, meta_iterations=1000)]


def test_challenger_scores_in_unit_interval(spark):
    out = QUERIES["graph_challenger_score"](spark, SF_SMALL)
    agg = out.agg(F.min("challenger_score").alias("lo"), F.max("challenger_score").alias("hi"),
                  F.count(F.lit(1)).alias("n")).first()
    assert 0.0 <= agg.lo <= agg.hi <= 1.0
    assert agg.n == QUERIES["prj_staging_orders"](spark, SF_SMALL).count()


def test_reputation_bounds_on_real_data(spark):
    r = QUERIES["rule_reputation_score"](spark, SF_SMALL).agg(
        F.min("reputation_score").alias("lo"), F.max("reputation_score").alias("hi")).first()
    assert 0 <= r.lo <= r.hi <= 100


def test_pr_auc_not_below_base_rate(spark):
    r = QUERIES["ml_pr_auc_roc_auc"](spark, SF_SMALL).first()
    base = r.n_pos / (r.n_pos + r.n_neg)
    assert r.pr_auc >= base
    assert 0.0 <= r.roc_auc <= 1.0
