"""What the feature, drift and graph queries store and shuffle: columns that are used, a row an order, one join of the orders."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orderflow.operators import features, graph
from orderflow.plans import catalog_ml
from orderflow.plans.context import OrderContext
from orderflow.plans.registry import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """200 events over ten days and their 100 products."""
    root = str(tmp_path_factory.mktemp("tables"))
    i = F.col("id")
    spark.range(200).select(i.alias("event_id"), F.timestamp_micros(i * 4_320_000_000 + F.lit(1704067200000000)).alias("ts"), ((i * 11) % 23).alias("user_id"),
                            F.lit("purchase").alias("event_type"), ((i * 37) % 500 + 0.25).cast("double").alias("value"),
                            F.concat(F.lit('{"k": '), ((i * 29) % 100).cast("string"), F.lit("}")).alias("props")).write.parquet(f"{root}/events.parquet")
    spark.range(100).select(i.alias("p_partkey"), F.concat(F.lit("part "), i.cast("string")).alias("p_name"),
                            F.concat(F.lit("TYPE"), (i % 4).cast("string")).alias("p_type")).write.parquet(f"{root}/part.parquet")
    return root


@pytest.fixture
def stored(monkeypatch):
    """(columns, rows) of what is checkpointed."""
    seen, cut = [], features.cut_lineage

    def seen_cut(df):
        out = cut(df)
        seen.append((out.columns, out.count()))
        return out

    from orderflow.operators import ranking
    for module in (features, ranking, catalog_ml):
        monkeypatch.setattr(module, "cut_lineage", seen_cut)
    return seen


def test_only_what_features_are_made_of_is_split(spark, tables, stored):
    catalog_ml.feature_frame(OrderContext(spark, tables), "is_new_user")
    columns, rows = stored[0]
    assert {"order_id", "account_age_days"} <= set(columns) and rows > 150
    assert not {"fraud_reasoning", "ip_address", "product_name", "category", "payment_method"} & set(columns)


def test_drift_stores_a_row_an_order(spark, tables, stored):
    row = QUERIES["drift_gate"](spark, tables).first()
    orders = max(n for columns, n in stored if "order_id" in columns)
    assert orders > 150 and 0 < row.n_current <= orders
    # The only other table is that of the distinct values, which has no row of a single order.
    assert all(n <= orders for columns, n in stored if "__bucket" not in columns)


def test_distribution_reads_the_orders_once(spark, tables, stored):
    df = QUERIES["agg_distribution_stats"](spark, tables)
    assert df.count() == len(catalog_ml.DIST_COLS)
    assert sum({"split", *catalog_ml.DIST_COLS} <= set(columns) for columns, _ in stored) == 1


def linked(a, b):
    return a is not b and ((a[1] is not None and a[1] == b[1]) or (a[2] not in (None, "unknown") and a[2] == b[2]))


def test_two_hops_match_pairs_and_join_the_orders_once(spark):
    rnd = random.Random(7)
    hashed = ["%064x" % rnd.getrandbits(256) for _ in range(3)]
    rows = [(f"o{i}", rnd.choice([*hashed, "u1", "u2", None]), rnd.choice(["ip1", "ip2", "unknown", None, hashed[0].upper(), *(f"ip{j}" for j in range(9, 40))]),
             rnd.randint(1, 100) + 0.5, False) for i in range(90)] + [("alone", None, None, 3.5, True)]
    df = spark.createDataFrame(rows, "order_id string, user_id string, ip_address string, order_amount double, is_fraud boolean")
    amounts = [r[3] for r in rows]
    mean = sum(amounts) / len(rows)
    sd = (sum((a - mean) ** 2 for a in amounts) / len(rows)) ** 0.5
    x = {r[0]: (r[3] - mean) / sd for r in rows}
    near = {r[0]: [o[0] for o in rows if linked(r, o)] for r in rows}
    mean_of = lambda ids, of: sum(of[i] for i in ids) / len(ids) if ids else None
    one = {i: mean_of(near[i], x) for i in near}
    two = {i: mean_of(near[i], {k: v or 0.0 for k, v in one.items()}) for i in near}
    out = graph.neighbour_features(df)
    got = {r.order_id: r for r in out.collect()}
    assert set(got) == set(near)
    for i, r in got.items():
        assert r.degree == len(near[i])
        for a, b in ((r.amount_std, x[i]), (r.hop1_mean, one[i]), (r.hop2_mean, two[i])):
            assert (a is None and b is None) or abs(a - b) < 1e-9
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
