"""Headline-query benchmark.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each headline query to completion with the ``noop`` sink (the whole
plan executes, nothing is collected to the driver) and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orderflow.plans.registry import QUERIES  # noqa: E402
from orderflow.session import build_session  # noqa: E402

HEADLINE = (
    "prj_staging_orders",
    "mart_fraud_daily",
    "mart_dim_products",
    "mart_dim_users",
    "mart_fct_fraud_orders",
    "mart_fact_orders",
    "agg_orders_per_minute",
    "top_fraud_feed",
    "jn_velocity_range",
    "win_velocity_1m",
    "jn_blocklist_anti",
    "rule_decision",
    "feat_matrix",
    "ml_threshold_cost",
    "ml_pr_auc_roc_auc",
    "drift_ks_wasserstein",
    "graph_neighbor_features",
    "mart_forecast_vs_actuals",
    "ts_training_windows",
    "rag_topk_cosine",
)


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    # Untimed warm-up on the smallest tables: JIT-compiles the shared code
    # paths (adapter, windows, checkpoints) so timings reflect steady state.
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in ("prj_staging_orders", "mart_dim_products", "feat_matrix"):
        run(spark, name, warm_dir if os.path.isdir(warm_dir) else sf_dir)
    timings = {n: run(spark, n, sf_dir) for n in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
