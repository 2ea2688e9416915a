"""Queries that mask rows themselves, in a session that is on a cluster and names no hash key: they run, and their rows are those of their SQL."""

from __future__ import annotations

import duckdb
import pytest

from orderflow.operators import staging
from orderflow.plans.registry import ORACLE, QUERIES
from orderflow.sources import ingest
from orderflow.streaming import order_stream

import scripts.check_oracle as chk  # noqa: E402

NAMES = ("flt_rejected_orders", "prj_pii_mask", "snk_dead_letter", "snk_foreach_batch", "snk_lake_archive", "stream_checkpoint",
         "stream_guard_split", "stream_idempotent", "stream_minute_rollup", "stream_multi_sink", "stream_score",
         "stream_ttl_features", "stream_velocity", "stream_watermark")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """300 events over three days, a few users with many in a minute, and their 100 products."""
    root = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    con.execute(f"""COPY (
        SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds((i // 5) * 4320000000 + (i % 5) * 20000000) AS ts, (i // 5) % 7 AS user_id,
               'purchase' AS event_type, CAST((i * 37) % 500 + 0.25 AS DOUBLE) AS value, '{{"k": ' || ((i * 29) % 100) || '}}' AS props
        FROM range(300) t(i)) TO '{root}/events.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (
        SELECT i AS p_partkey, 'part ' || i AS p_name, 'TYPE' || (i % 4) AS p_type FROM range(100) t(i)) TO '{root}/part.parquet' (FORMAT parquet)""")
    for t in ("events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return str(root), con


@pytest.fixture
def cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert spark.conf.get(staging.USER_HASH_CONF, None) is None
    return spark


@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_cluster_matches_its_sql(cluster, tables, name):
    folder, con = tables
    df = QUERIES[name](cluster, folder)
    got = chk.rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    assert got and got == chk.rows_of([x[0] for x in res.description], res.fetchall())


def test_a_stream_without_a_key_is_still_an_error_on_a_cluster(cluster, tmp_path):
    row = cluster.createDataFrame([("{}",)], "value string")
    with pytest.raises(RuntimeError, match="not set"):
        order_stream.process_batch(ingest.decode_orders(row), 0, order_stream.StreamOutputs(str(tmp_path)))
