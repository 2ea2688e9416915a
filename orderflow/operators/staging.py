"""Guard, masking, scoring columns, dedup and the staging projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from orderflow.functions import rules
from orderflow.functions.timeparts import dow_sunday0, is_late_night_warehouse

REJECT_REASONS = ("NULL_OR_BAD_AMOUNT", "NULL_USER", "NULL_OR_FUTURE_TIMESTAMP")


def _valid_amount() -> Column:
    a = F.col("amount")
    return (a > rules.VALID_AMOUNT_LOW) & (a < rules.VALID_AMOUNT_HIGH)


def guard_condition(as_of: Column) -> Column:
    """Amount in range, user present, timestamp not after ``as_of``.

    NULL inputs make the raw condition NULL; ``coalesce(..., false)`` sends
    such rows to the rejected side instead of losing them from both.
    """
    cond = _valid_amount() & F.col("user_id").isNotNull() & (F.col("timestamp") <= as_of)
    return F.coalesce(cond, F.lit(False))


def valid_orders(raw: DataFrame, as_of: Column) -> DataFrame:
    return raw.filter(guard_condition(as_of))


def rejected_orders(raw: DataFrame, as_of: Column) -> DataFrame:
    """Complement of the guard with the first failed check as ``reject_reason``."""
    return raw.filter(~guard_condition(as_of)).withColumn("reject_reason", guard_reason())


def guard_reason() -> Column:
    """The first check of the guard that a rejected row fails."""
    return (F.when(~F.coalesce(_valid_amount(), F.lit(False)), REJECT_REASONS[0])
            .when(F.col("user_id").isNull(), REJECT_REASONS[1])
            .otherwise(REJECT_REASONS[2]))


# Key of the user and address hashes; sessions on one machine (tests, bench) may leave it unset.
USER_HASH_KEY, USER_HASH_CONF = "orderflow", "spark.orderflow.user.hash.key"


def hash_key(spark: SparkSession) -> str:
    """The secret that the session names. On a cluster there is no default: a known key protects nobody."""
    key = spark.conf.get(USER_HASH_CONF, None)
    if not key and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{USER_HASH_CONF} is not set; users and addresses can't be hashed without a key")
    return key or USER_HASH_KEY


def mask_pii(df: DataFrame, key: str | None = None) -> DataFrame:
    """Keyed SHA-256 of the user and of the IP, in place of the clear values.

    The same user always has the same hash, so marts can still group by it; a
    null user stays null. Without ``key`` the session has to name one.
    """
    prefix = F.lit(f"{key or hash_key(df.sparkSession)}-")
    return df.withColumns({c: F.sha2(F.concat(prefix, F.col(c)), 256) for c in ("user_id", "ip_address")})


def with_scoring(df: DataFrame, score_col: str = "fraud_score") -> DataFrame:
    """is_fraud, risk_level and a reasoning string from the top drivers."""
    drivers = rules.top_drivers(F.col("orders_per_user_1m"), F.col("location_mismatch"), F.col("amount"))
    return (df.withColumn("is_fraud", rules.is_fraud(score_col))
              .withColumn("risk_level", rules.risk_level(score_col))
              .withColumn("reasoning", F.array_join(drivers, "; ")))


def processed_orders(raw: DataFrame, as_of: Column, key: str | None = None) -> DataFrame:
    """What the stream writes to the operational table: valid, masked, scored.

    ``order_amount`` mirrors ``amount`` (the stream writes one, staging reads
    the other; reading ``coalesce(order_amount, amount)`` bridges both).
    """
    valid = mask_pii(valid_orders(raw, as_of), key)
    return with_scoring(valid).withColumn("order_amount", F.col("amount"))


def dedup_latest(df: DataFrame, key: str, order_desc: Sequence[str]) -> DataFrame:
    """Keep one row per ``key``: the greatest by ``order_desc``, then by a hash of the row.

    Grouped ``max_by`` instead of ``row_number`` over a key window: the partial
    aggregate collapses copies map-side, so a key that was re-sent millions of
    times still costs one row per map task in the shuffle. Columns that nobody
    asks for are pruned; only their part of the hash is computed before.
    """
    rest = [c for c in df.columns if c != key]
    order = F.struct(*[F.col(c) for c in order_desc], F.col("__tie"))
    rows = df.filter(F.col(key).isNotNull()).withColumn("__tie", F.xxhash64(*df.columns))
    return rows.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(*df.columns)


def staging_orders(processed: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Typed, renamed, deduplicated staging rows with derived flags.

    ``extra`` carries further processed columns through (the star fact needs
    product_id, quantity and payment_method).
    """
    src = processed.withColumn("order_amount", F.coalesce(F.col("order_amount"), F.col("amount")))
    latest = dedup_latest(
        src.select("order_id", "user_id", "order_amount", "product_name", "category", "device_type",
                   "timestamp", "is_fraud", "fraud_score", "risk_level", "location_mismatch",
                   "orders_per_user_1m", "reasoning", *extra),
        "order_id", ["timestamp", "orders_per_user_1m", "fraud_score"])
    ts = F.col("timestamp")
    amount = F.col("order_amount").cast(DecimalType(12, 2))
    return latest.filter((F.col("order_amount") > 0) & (F.col("order_amount") < 100000)).select(
        F.col("order_id"),
        F.col("user_id"),
        amount.alias("order_amount"),
        F.col("product_name"),
        F.col("category"),
        F.col("device_type"),
        ts.alias("order_timestamp"),
        F.to_date(ts).alias("order_date"),
        F.hour(ts).cast("int").alias("order_hour"),
        dow_sunday0(ts).alias("day_of_week"),
        dow_sunday0(ts).isin(0, 6).alias("is_weekend"),
        F.col("is_fraud").cast("boolean").alias("is_fraud"),
        F.col("fraud_score").cast(DecimalType(6, 4)).alias("fraud_score"),
        F.col("risk_level"),
        F.col("location_mismatch").cast("boolean").alias("location_mismatch"),
        F.col("orders_per_user_1m").cast("int").alias("orders_per_user_1m"),
        F.col("reasoning").alias("fraud_reasoning"),
        (amount > rules.HIGH_VALUE_WAREHOUSE).alias("is_high_value"),
        is_late_night_warehouse(ts).alias("is_late_night_order"),
        *[F.col(c) for c in extra],
    )
