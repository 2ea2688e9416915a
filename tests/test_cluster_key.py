"""Queries in a session that is on a cluster and names no hash key: they run, and their rows are those of their SQL."""

from __future__ import annotations

import duckdb
import pytest

from orderflow.operators import staging
from orderflow.plans.context import OrderContext
from orderflow.plans.registry import ORACLE, QUERIES

import scripts.check_oracle as chk  # noqa: E402

NAMES = ("agg_case_count", "agg_class_balance", "agg_conditional", "agg_distinct_users", "agg_distribution_stats",
         "agg_feedback_count", "agg_forecast_accuracy", "agg_forecast_series", "agg_fraud_daily", "agg_hourly_category",
         "agg_kpi_fraud_orders", "agg_kpi_fraud_rate", "agg_kpi_orders", "agg_kpi_revenue", "agg_median", "agg_mode",
         "agg_orders_per_hour", "agg_orders_per_minute", "agg_product_dim", "agg_quantiles", "agg_revenue_by_category",
         "agg_risk_counts", "agg_user_dim", "agg_user_mean_std")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """600 events over 12 days and their 100 products, and a connection that sees both."""
    root = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    con.execute(f"""COPY (
        SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 1728000000 + i * 7919) AS ts, (i * 11) % 23 AS user_id,
               'purchase' AS event_type, CAST((i * 37) % 500 + 0.25 AS DOUBLE) AS value, '{{"k": ' || ((i * 29) % 100) || '}}' AS props
        FROM range(600) t(i)) TO '{root}/events.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (
        SELECT i AS p_partkey, 'part ' || i AS p_name, 'TYPE' || (i % 4) AS p_type FROM range(100) t(i)) TO '{root}/part.parquet' (FORMAT parquet)""")
    for t in ("events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return str(root), con


@pytest.fixture
def cluster(spark, monkeypatch):
    """Its session says so; it names a checkpoint folder already, and no key."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert spark.conf.get(staging.USER_HASH_CONF, None) is None
    return spark


@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_cluster_matches_its_sql(cluster, tables, name):
    folder, con = tables
    df = QUERIES[name](cluster, folder)
    got = chk.rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    assert got == chk.rows_of([x[0] for x in res.description], res.fetchall())


def test_the_key_of_the_session_goes_first(cluster, tables):
    users = lambda: {r.user_id for r in OrderContext(cluster, tables[0]).processed.select("user_id").collect()}
    plain = users()
    cluster.conf.set(staging.USER_HASH_CONF, "other")
    try:
        assert len(users()) == len(plain) and not users() & plain
    finally:
        cluster.conf.unset(staging.USER_HASH_CONF)


def test_masking_without_a_key_is_still_an_error_on_a_cluster(cluster):
    rows = cluster.createDataFrame([("u", "10.0.0.1")], "user_id string, ip_address string")
    with pytest.raises(RuntimeError, match="not set"):
        staging.mask_pii(rows)
    assert len(staging.mask_pii(rows, "key").first().user_id) == 64
