"""Test tables -> the scored order rows the stream would have written.

The driver's ``events`` table is the order stream and ``part`` the product
catalogue. The mapping is deterministic and injects the dirt the pipeline
must handle: 2 % re-sent orders, NULL users, negative and inflated amounts,
and far-future timestamps. Identical SQL for the oracle is in
``orderflow.plans.oracle``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from orderflow.functions.scalars import one_row, ts_literal
from orderflow.operators.velocity import trailing_count
from orderflow.sources.tables import table

# Fixed values of the fixture mapping.
NULL_USER_K = 13
NEGATIVE_AMOUNT_K = 17
FUTURE_K = 19
FUTURE_DAYS = 3650
ADDRESSES = 40                      # users share a shipping address by user_id % 40
CHECKOUT_SECONDS = 45               # checkout took event_id % 45 seconds
INFLATE_EVERY_K = 10                # k % 10 = 0 -> amount * 25
INFLATE_FACTOR = 25
RESEND_EVERY = 50                   # event_id % 50 = 0 is sent twice, 1 s later
MISMATCH_EVERY = 5                  # event_id % 5 = 0 -> location mismatch
CLOCK_EPOCH_US = 1704067200000000   # 2024-01-01T00:00:00Z
CLOCK_COMPRESSION = 1440            # one day of event time -> one burst minute
VELOCITY_WIDTH_US = 59_999_999
PAYMENT_METHODS = ("Credit Card", "UPI", "PayPal", "Debit Card")
DEVICE_TYPES = ("mobile", "desktop", "tablet")

SCORE_TYPE = DecimalType(6, 4)
AMOUNT_TYPE = DecimalType(12, 2)


def _d(x: str) -> Column:
    return F.lit(Decimal(x)).cast(SCORE_TYPE)


def fixture_score(location_mismatch: Column, amount: Column, ts: Column, velocity: Column) -> Column:
    """Stand-in for the external model score, DECIMAL(6,4) in [0, 1]."""
    raw = (_d("0.05")
           + _d("0.25") * location_mismatch
           + F.when(amount > 1000, _d("0.35")).otherwise(_d("0"))
           + F.when(F.hour(ts).between(0, 5), _d("0.10")).otherwise(_d("0"))
           + _d("0.03") * F.least(velocity, F.lit(10)))
    return F.least(F.lit(Decimal(1)).cast(SCORE_TYPE), raw.cast(SCORE_TYPE)).cast(SCORE_TYPE)


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored order rows before the data-quality guard (the stream's input)."""
    ev = table(spark, sf_dir, "events")
    # An order without a known product keeps its row, with no name and category.
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    e = ev.select(
        "event_id", "user_id", "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )
    k = F.col("k")
    amount = (F.when(k == NEGATIVE_AMOUNT_K, (-F.col("value")).cast(AMOUNT_TYPE))
              .when(k % INFLATE_EVERY_K == 0,
                    (F.col("value").cast(AMOUNT_TYPE) * INFLATE_FACTOR).cast(AMOUNT_TYPE))
              .otherwise(F.col("value").cast(AMOUNT_TYPE)))
    base = e.join(part, e.k == part.p_partkey, "left").select(
        "event_id",
        F.concat(F.lit("ORD-"), F.col("event_id").cast("string")).alias("order_id"),
        F.when(k == NULL_USER_K, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("user_id"),
        F.concat(F.lit("PROD-"), k.cast("string")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        amount.alias("amount"),
        (F.lit(1) + k % 5).cast("int").alias("quantity"),
        F.when(k % 4 == 0, PAYMENT_METHODS[0]).when(k % 4 == 1, PAYMENT_METHODS[1])
         .when(k % 4 == 2, PAYMENT_METHODS[2]).otherwise(PAYMENT_METHODS[3]).alias("payment_method"),
        F.concat(F.lit("10.0."), k.cast("string"), F.lit("."),
                 (F.col("user_id") % 20).cast("string")).alias("ip_address"),
        F.when(k % 3 == 0, DEVICE_TYPES[0]).when(k % 3 == 1, DEVICE_TYPES[1])
         .otherwise(DEVICE_TYPES[2]).alias("device_type"),
        F.when(F.col("event_id") % MISMATCH_EVERY == 0, 1).otherwise(0).cast("int").alias("location_mismatch"),
        ((F.col("user_id") * 37) % 400).cast("int").alias("account_age_days"),
        F.concat(F.lit("addr_"), (F.col("user_id") % ADDRESSES).cast("string")).alias("shipping_address"),
        (F.col("event_id") % CHECKOUT_SECONDS).cast("int").alias("checkout_seconds"),
        F.when(k == FUTURE_K, F.col("ts") + F.expr(f"INTERVAL {FUTURE_DAYS} DAYS"))
         .otherwise(F.col("ts")).alias("timestamp"),
        F.floor((F.unix_micros("ts") - F.lit(CLOCK_EPOCH_US)) / F.lit(CLOCK_COMPRESSION))
         .cast("long").alias("burst_us"),
    )
    # Re-sent orders: every RESEND_EVERY-th event also arrives 1 s later. The
    # copies come from the same scan (explode), not from a second read.
    copies = F.when(F.col("event_id") % RESEND_EVERY == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dup = (base.withColumn("__copy", F.explode(copies))
               .withColumn("timestamp", F.when(F.col("__copy") == 1, F.col("timestamp") + F.expr("INTERVAL 1 SECOND"))
                           .otherwise(F.col("timestamp")))
               .drop("__copy", "event_id"))
    vel = trailing_count(dup, ["user_id"], "burst_us", VELOCITY_WIDTH_US, "orders_per_user_1m")
    vel = vel.withColumn("orders_per_user_1m", F.col("orders_per_user_1m").cast("int"))
    return vel.withColumn(
        "fraud_score",
        fixture_score(F.col("location_mismatch"), F.col("amount"), F.col("timestamp"),
                      F.col("orders_per_user_1m")),
    )


def as_of_clock(spark: SparkSession, sf_dir: str) -> Column:
    """Reproducible ``NOW()``: the newest order that the fixture did not push ahead.

    Read from the events alone and used as a literal, so time filters fold into
    constants and can prune a date-partitioned archive.
    """
    k = F.get_json_object("props", "$.k").try_cast("int")
    sent = F.unix_micros(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % RESEND_EVERY == 0, 1_000_000).otherwise(0)
    r = one_row(table(spark, sf_dir, "events").filter(F.coalesce(k != FUTURE_K, F.lit(True))).agg(F.max(sent).alias("us")))
    return ts_literal(r.us)
