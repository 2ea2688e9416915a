"""Dashboard panels over the operational table (processed orders).

The relative windows (``NOW() - INTERVAL``) are taken from an explicit
``as_of`` column. Time filters are plain predicates on ``timestamp``, so on a
date-partitioned archive they prune partitions and reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from orderflow.functions.exact import ratio_round
from orderflow.operators.aggregates import count_if


def since(as_of: Column, hours: int) -> Column:
    return F.col("timestamp") > as_of - F.expr(f"INTERVAL {hours} HOURS")


def orders_per_minute(processed: DataFrame, as_of: Column) -> DataFrame:
    return (processed.filter(since(as_of, 1))
            .groupBy(F.date_trunc("minute", "timestamp").alias("minute"))
            .agg(F.count(F.lit(1)).alias("order_count")))


def orders_per_hour(processed: DataFrame, as_of: Column) -> DataFrame:
    return (processed.filter(since(as_of, 24))
            .groupBy(F.date_trunc("hour", "timestamp").alias("time"))
            .agg(F.count(F.lit(1)).alias("actual_orders")))


def revenue_by_category(processed: DataFrame, as_of: Column) -> DataFrame:
    return (processed.filter(since(as_of, 24)).groupBy("category")
            .agg(F.sum("amount").cast(DecimalType(18, 2)).alias("total_revenue")))


def fraud_alerts_feed(processed: DataFrame, n: int = 10) -> DataFrame:
    """Latest ``n`` fraud rows; the limit is the panel's feature (top-n)."""
    return (processed.filter(F.col("is_fraud"))
            .select("timestamp", "order_id", "user_id", "amount", "orders_per_user_1m",
                    "fraud_score", "risk_level", "reasoning")
            .orderBy(F.col("timestamp").desc(), F.col("order_id").desc())
            .limit(n))


def top_products(processed: DataFrame, as_of: Column, hours: int = 6, n: int = 5) -> DataFrame:
    """Top ``n`` products by volume in the last ``hours`` (name breaks ties)."""
    return (processed.filter(since(as_of, hours)).groupBy("product_name")
            .agg(F.count(F.lit(1)).alias("volume"))
            .orderBy(F.col("volume").desc(), F.col("product_name").asc())
            .limit(n))


def kpi_fraud_rate(processed: DataFrame, as_of: Column) -> DataFrame:
    recent = processed.filter(since(as_of, 1))
    agg = recent.agg(count_if(F.col("is_fraud")).alias("f"), F.count(F.lit(1)).alias("n"))
    return agg.select(ratio_round(F.col("f") * 100, "n", 2, 10).alias("fraud_rate_pct"))


def kpi_orders(processed: DataFrame, as_of: Column) -> DataFrame:
    return processed.filter(since(as_of, 1)).agg(F.count(F.lit(1)).alias("total_orders"))


def kpi_fraud_orders(processed: DataFrame, as_of: Column) -> DataFrame:
    return (processed.filter(F.col("is_fraud") & since(as_of, 1))
            .agg(F.count(F.lit(1)).alias("fraud_orders")))


def kpi_revenue(processed: DataFrame, as_of: Column) -> DataFrame:
    return (processed.filter(since(as_of, 24))
            .agg(F.sum("amount").cast(DecimalType(18, 2)).alias("total_revenue")))


def risk_counts(processed: DataFrame) -> DataFrame:
    """Batch tiles: CRITICAL / HIGH / fraud counts, fraud rate and revenue."""
    agg = processed.agg(
        count_if(F.col("risk_level") == "CRITICAL").alias("critical_count"),
        count_if(F.col("risk_level") == "HIGH").alias("high_count"),
        count_if(F.col("is_fraud")).alias("fraud_count"),
        F.count(F.lit(1)).alias("total_count"),
        F.sum("amount").cast(DecimalType(18, 2)).alias("total_revenue"),
    )
    return agg.withColumn("fraud_rate_pct", ratio_round(F.col("fraud_count") * 100, "total_count", 1, 10))


def top_critical(processed: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` CRITICAL rows of the batch (newest first, id breaks ties)."""
    return (processed.filter(F.col("risk_level") == "CRITICAL")
            .select("order_id", "user_id", "amount", "fraud_score", "timestamp")
            .orderBy(F.col("timestamp").desc(), F.col("order_id").desc()).limit(n))


def recent_windows(processed: DataFrame, as_of: Column) -> DataFrame:
    """Order counts in the trailing 1 h, 6 h, 24 h and 30 d, in one scan."""
    return processed.agg(
        count_if(since(as_of, 1)).alias("orders_1h"),
        count_if(since(as_of, 6)).alias("orders_6h"),
        count_if(since(as_of, 24)).alias("orders_24h"),
        count_if(since(as_of, 24 * 30)).alias("orders_30d"),
    )


def time_band(processed: DataFrame, center: Column, hours: int = 6) -> DataFrame:
    """Rows strictly inside ``center`` ± ``hours``."""
    iv = F.expr(f"INTERVAL {hours} HOURS")
    return processed.filter((F.col("timestamp") > center - iv) & (F.col("timestamp") < center + iv)) \
                    .select("order_id", "timestamp", "amount", "category")


def recent_table(processed: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Drift input: last ``hours`` of (amount, velocity, label) with a positive amount."""
    amount = F.coalesce(F.col("amount"), F.col("order_amount"))
    return (processed.filter(since(as_of, hours) & (F.col("order_amount") > 0))
            .select("order_id", "timestamp", amount.alias("order_amount"),
                    F.col("orders_per_user_1m").alias("velocity"),
                    F.col("is_fraud").cast("int").alias("is_fraud")))

