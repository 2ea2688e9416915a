"""Guard, dedup, mode, median and rank semantics on literal edge tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from orderflow.operators import staging
from orderflow.operators.aggregates import mode_smallest
from orderflow.operators.stats import group_median
from orderflow.operators.ranking import with_rank

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def test_guard_partitions_every_row(spark):
    rows = [("a", "u", Decimal("10.00"), T0), ("b", "u", None, T0), ("c", "u", Decimal("0.00"), T0),
            ("d", "u", Decimal("100000.00"), T0), ("e", None, Decimal("5.00"), T0),
            ("f", "u", Decimal("5.00"), None), ("g", "u", Decimal("5.00"), T0 + dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "order_id string, user_id string, amount decimal(12,2), timestamp timestamp")
    as_of = F.lit(T0).cast("timestamp")
    valid = {r.order_id for r in staging.valid_orders(df, as_of).collect()}
    rej = {r.order_id: r.reject_reason for r in staging.rejected_orders(df, as_of).collect()}
    assert valid == {"a"}
    assert set(rej) == {"b", "c", "d", "e", "f", "g"}  # NULL amount/time rows are not lost
    assert rej["b"] == "NULL_OR_BAD_AMOUNT" and rej["e"] == "NULL_USER" and rej["g"] == "NULL_OR_FUTURE_TIMESTAMP"


def test_dedup_latest_keeps_newest_and_drops_null_keys(spark):
    rows = [("o1", T0, 1, "x"), ("o1", T0 + dt.timedelta(seconds=1), 1, "y"), ("o2", T0, 1, "p"),
            ("o2", T0, 3, "q"), (None, T0, 1, "z")]
    df = spark.createDataFrame(rows, "order_id string, ts timestamp, v int, payload string")
    got = {r.order_id: r.payload for r in staging.dedup_latest(df, "order_id", ["ts", "v"]).collect()}
    assert got == {"o1": "y", "o2": "q"}


def test_mode_ties_and_nulls(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", "a"), ("h", None)], "k string, v string")
    got = {r.k: r.m for r in df.groupBy("k").agg(mode_smallest("v").alias("m")).collect()}
    assert got == {"g": "a", "h": None}


def test_median_even_count(spark):
    df = spark.createDataFrame([("g", Decimal("1.00")), ("g", Decimal("2.01")), ("g", Decimal("3.00")),
                                ("g", Decimal("10.00")), ("h", Decimal("7.00"))], "k string, a decimal(12,2)")
    got = {r.k: r.m for r in group_median(df, ["k"], "a", "m").collect()}
    assert got == {"g": Decimal("2.505"), "h": Decimal("7.000")}


def test_rank_with_ties_per_group(spark):
    df = spark.createDataFrame([("c", 5), ("c", 5), ("c", 3), ("d", 1), (None, 2), (None, 2)], "g string, v long")
    got = sorted((r.g or "", r.v, r.r) for r in with_rank(df, ["g"], "v", "r").collect())
    assert got == [("", 2, 1), ("", 2, 1), ("c", 3, 3), ("c", 5, 1), ("c", 5, 1), ("d", 1, 1)]
