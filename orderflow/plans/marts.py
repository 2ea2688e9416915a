"""Warehouse marts built from the staging rows.

Each function takes the staging DataFrame plus an explicit ``as_of`` column
(the reproducible ``NOW()``) and returns a lazy DataFrame. Marts are
aggregates with map-side partial aggregation; the only windows without a
partition key run over per-day or per-hour rows, bounded by the time span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from orderflow.functions import rules
from orderflow.functions.exact import mean_double, ratio_round, scaled_int
from orderflow.functions.timeparts import dow_sunday0, whole_days
from orderflow.operators.aggregates import count_if, mode_smallest, sum_if
from orderflow.operators.common import join_null_safe
from orderflow.operators.stats import group_median
from orderflow.operators.ranking import with_rank
from orderflow.session import cut_lineage

MONEY = DecimalType(18, 2)


def _fraud() -> Column:
    return F.col("is_fraud")


def fraud_daily(stg: DataFrame, as_of: Column) -> DataFrame:
    """One row per order date with counts, exposure, rates and day-over-day trends."""
    daily = stg.groupBy("order_date").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.countDistinct("user_id").alias("unique_users"),
        F.sum("order_amount").cast(MONEY).alias("total_revenue_usd"),
        count_if(_fraud()).alias("fraud_orders"),
        count_if(F.col("risk_level") == "CRITICAL").alias("critical_orders"),
        count_if(F.col("risk_level") == "HIGH").alias("high_risk_orders"),
        sum_if(_fraud(), "order_amount").alias("fraud_revenue_at_risk_usd"),
        F.sum(scaled_int("fraud_score", 4)).alias("__score_units"),
        F.sum(F.when(_fraud(), scaled_int("fraud_score", 4))).alias("__fraud_score_units"),
        count_if(F.col("location_mismatch")).alias("location_mismatch_count"),
        count_if(F.col("is_late_night_order") & _fraud()).alias("late_night_fraud_count"),
        count_if(F.col("is_high_value") & _fraud()).alias("high_value_fraud_count"),
        mode_smallest(F.when(_fraud(), F.col("category"))).alias("top_fraud_category"),
    )
    daily = (daily
             .withColumn("fraud_rate_pct", ratio_round(F.col("fraud_orders") * 100, "total_orders", 3, 10))
             .withColumn("avg_fraud_score", ratio_round("__score_units", F.col("total_orders") * 10000, 4, 10))
             .withColumn("avg_fraud_score_on_positives",
                         ratio_round("__fraud_score_units", F.col("fraud_orders") * 10000, 4, 10)))
    # Day-level rows: at most one per calendar day, so the ordered window is
    # bounded by the time span, not by the number of orders.
    by_day = Window.orderBy("order_date")
    rate_units = scaled_int("fraud_rate_pct", 3)
    week = by_day.rowsBetween(-6, 0)
    return daily.select(
        "order_date", "total_orders", "unique_users", "total_revenue_usd", "fraud_orders",
        "critical_orders", "high_risk_orders", "fraud_revenue_at_risk_usd", "fraud_rate_pct",
        "avg_fraud_score", "avg_fraud_score_on_positives", "location_mismatch_count",
        "late_night_fraud_count", "high_value_fraud_count", "top_fraud_category",
        ratio_round(F.sum(rate_units).over(week), F.count(F.lit(1)).over(week) * 1000, 3, 10).alias("fraud_rate_7d_avg"),
        (F.col("fraud_orders") - F.lag("fraud_orders", 1).over(by_day)).alias("fraud_orders_dod_change"),
        (F.col("total_orders") - F.lag("total_orders", 1).over(by_day)).alias("total_orders_dod_change"),
        (F.col("fraud_rate_pct") - F.lag("fraud_rate_pct", 7).over(by_day)).cast(DecimalType(10, 3))
        .alias("fraud_rate_wow_change"),
        as_of.alias("dbt_updated_at"),
    )


def dim_products(stg: DataFrame, as_of: Column, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per (product_name, category) with volume, revenue, fraud and ranks; only the columns
    ``cols``, if they are named, and nothing that the others would need."""
    asked = {"median_order_value_usd", "rank_in_category", "revenue_rank_overall"} & set(cols) if cols else {"median_order_value_usd", "rank_in_category", "revenue_rank_overall"}
    stats = stg.groupBy("product_name", "category").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.countDistinct("user_id").alias("unique_buyers"),
        F.sum("order_amount").cast(MONEY).alias("total_revenue_usd"),
        mean_double(F.sum("order_amount"), F.count(F.lit(1))).alias("avg_order_value_usd"),
        F.min("order_amount").alias("min_order_value_usd"),
        F.max("order_amount").alias("max_order_value_usd"),
        count_if(_fraud()).alias("fraud_order_count"),
        sum_if(_fraud(), "order_amount").alias("total_fraud_exposure_usd"),
        F.min("order_timestamp").alias("first_order_at"),
        F.max("order_timestamp").alias("last_order_at"),
        F.sum("orders_per_user_1m").alias("__vel_sum"),
        count_if(F.col("is_late_night_order")).alias("late_night_order_count"),
        count_if(F.col("is_high_value")).alias("high_value_order_count"),
    )
    stats = (stats
             .withColumn("fraud_rate_pct", ratio_round(F.col("fraud_order_count") * 100, "total_orders", 2, 10))
             .withColumn("avg_velocity_per_user", ratio_round("__vel_sum", "total_orders", 2, 10))
             .drop("__vel_sum")
             .withColumn("product_risk_tier", rules.product_risk_tier("fraud_rate_pct")))
    # Exact medians from cumulative counts (no per-group value map in one task).
    if "median_order_value_usd" in asked:
        stats = join_null_safe(stats, group_median(stg, ["product_name", "category"], "order_amount",
                                                   "median_order_value_usd"), ["product_name", "category"], "left")
    ranks = {"rank_in_category": (["category"], "total_orders"), "revenue_rank_overall": ([], "total_revenue_usd")}
    if asked & set(ranks):
        # One row per product, read by the rankings and the final join.
        stats = cut_lineage(stats.select(*[c for c in stats.columns if not cols or c in (*cols, "product_name", "category") or c in [v for r, (_, v) in ranks.items() if r in asked]]))
    for name, (parts, value) in ranks.items():
        if name in asked:
            stats = with_rank(stats, parts, value, name, descending=True)
    stats = stats.withColumn("dbt_updated_at", as_of)
    return stats.select(*cols) if cols else stats


def dim_users(stg: DataFrame, as_of: Column, lookback_days: int = rules.LOOKBACK_DAYS, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per user: history, spend, fraud, behaviour, reputation, segment, tier; only the columns
    ``cols``, if they are named."""
    recent = F.col("order_timestamp") > as_of - F.expr(f"INTERVAL {lookback_days} DAYS")
    stats = stg.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.min("order_timestamp").alias("first_order_at"),
        F.max("order_timestamp").alias("last_order_at"),
        F.sum("order_amount").cast(MONEY).alias("total_spend_usd"),
        mean_double(F.sum("order_amount"), F.count(F.lit(1))).alias("avg_order_value_usd"),
        F.max("order_amount").alias("max_single_order_usd"),
        count_if(_fraud()).alias("fraud_order_count"),
        mean_double(F.sum("fraud_score"), F.count("fraud_score")).alias("avg_fraud_score"),
        F.max("fraud_score").alias("max_fraud_score"),
        count_if(F.col("location_mismatch")).alias("location_mismatch_count"),
        count_if(F.col("is_late_night_order")).alias("late_night_order_count"),
        count_if(F.col("is_high_value")).alias("high_value_order_count"),
        mean_double(F.sum("orders_per_user_1m"), F.count("orders_per_user_1m")).alias("avg_velocity"),
        F.max("orders_per_user_1m").alias("peak_velocity"),
        mode_smallest("device_type").alias("preferred_device"),
        mode_smallest("category").alias("preferred_category"),
        count_if(recent).alias("orders_last_30d"),
        sum_if(recent, "order_amount").alias("spend_last_30d_usd"),
    )
    if not cols or "median_order_value_usd" in cols:
        stats = join_null_safe(stats, group_median(stg, ["user_id"], "order_amount", "median_order_value_usd"),
                               ["user_id"], "left")
    else:
        stats = stats.withColumn("median_order_value_usd", F.lit(None).cast("decimal(18,3)"))
    stats = (stats
             .withColumn("days_as_customer", whole_days("last_order_at", "first_order_at"))
             .withColumn("fraud_rate_pct", ratio_round(F.col("fraud_order_count") * 100, "total_orders", 2, 10)))
    out = stats.select(
        "user_id", "total_orders", "first_order_at", "last_order_at", "days_as_customer",
        "total_spend_usd", "avg_order_value_usd", "max_single_order_usd", "median_order_value_usd",
        "fraud_order_count", "fraud_rate_pct", "avg_fraud_score", "max_fraud_score",
        "location_mismatch_count", "late_night_order_count", "high_value_order_count",
        "avg_velocity", "peak_velocity", "preferred_device", "preferred_category",
        "orders_last_30d", "spend_last_30d_usd",
        rules.reputation_score("fraud_order_count", "location_mismatch_count", "peak_velocity",
                               "days_as_customer", "total_orders").alias("reputation_score"),
        rules.user_segment("fraud_order_count", "avg_fraud_score", "location_mismatch_count",
                           "total_orders").alias("user_segment"),
        rules.customer_value_tier("total_spend_usd").alias("customer_value_tier"),
        as_of.alias("dbt_updated_at"),
    )
    return out.select(*cols) if cols else out


def fct_fraud_orders(stg: DataFrame, as_of: Column) -> DataFrame:
    """Confirmed fraud rows with display label, pattern and loss estimates."""
    fraud = stg.filter(F.col("is_fraud"))
    return fraud.select(
        "order_id", "user_id", "order_amount", "category", "product_name", "device_type",
        "order_timestamp", "order_date", "order_hour", "day_of_week", "is_weekend",
        "is_late_night_order", "fraud_score", "risk_level", "fraud_reasoning",
        "location_mismatch", "orders_per_user_1m", "is_high_value",
        rules.risk_display("risk_level").alias("risk_display"),
        rules.fraud_pattern("location_mismatch", "orders_per_user_1m", "is_high_value",
                            "is_late_night_order").alias("fraud_pattern"),
        F.col("order_amount").alias("potential_loss_usd"),
        rules.estimated_loss("risk_level", "order_amount").alias("estimated_loss_usd"),
        as_of.alias("dbt_updated_at"),
    )


def hour_spine(stg: DataFrame, ts_col: str = "order_timestamp") -> DataFrame:
    """Every hour between the first and last order hour (one generated row each)."""
    bounds = stg.agg(F.date_trunc("hour", F.min(ts_col)).alias("lo"),
                     F.date_trunc("hour", F.max(ts_col)).alias("hi"))
    return bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("full_timestamp"))


def hour_number(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(3_600_000_000)).cast("long")


def dim_time(stg: DataFrame) -> DataFrame:
    """Date spine at hour grain with calendar attributes.

    ``time_id`` counts hours from 1970-01-01, so facts and dimension are numbered
    without looking at the data.
    """
    spine = hour_spine(stg)
    t = F.col("full_timestamp")
    hour = F.hour(t)
    dow = dow_sunday0(t)
    return spine.select(
        hour_number(t).alias("time_id"),
        t.alias("full_timestamp"),
        hour.cast("int").alias("hour"),
        dow.alias("day_of_week"),
        F.date_format(t, "EEEE").alias("day_name"),
        F.dayofmonth(t).alias("day_of_month"),
        F.weekofyear(t).alias("week_of_year"),
        F.month(t).alias("month"),
        F.date_format(t, "MMMM").alias("month_name"),
        F.quarter(t).alias("quarter"),
        F.year(t).alias("year"),
        dow.isin(0, 6).alias("is_weekend"),
        hour.between(0, 5).alias("is_late_night"),
        (hour.between(9, 17) & dow.between(1, 5)).alias("is_business_hours"),
    )


def fact_orders(stg_plus: DataFrame) -> DataFrame:
    """Star fact: one row per order with natural keys to the user, product and
    hour dimensions, measures and degenerate attributes.

    ``stg_plus`` is the staging frame carrying ``product_id``, ``quantity`` and
    ``payment_method`` as well (see ``staging_orders(..., extra=...)``).
    """
    return stg_plus.select(
        "order_id", "user_id", "product_id", "product_name", "category",
        hour_number(F.col("order_timestamp")).alias("time_id"),
        "order_amount", "quantity", "fraud_score", "is_fraud", "risk_level",
        rules.fraud_pattern("location_mismatch", "orders_per_user_1m", "is_high_value",
                            "is_late_night_order").alias("fraud_pattern"),
        "payment_method", "device_type", "location_mismatch",
    )


def star_join(fact: DataFrame, users: DataFrame, products: DataFrame, times: DataFrame) -> DataFrame:
    """Fact joined to its three dimensions (a typical star query).

    No join hints: the user and product dimensions grow with the data, so
    Catalyst/AQE picks sort-merge or (at run time, when small) broadcast.
    """
    return (fact
            .join(users.select("user_id", "user_segment", "customer_value_tier"), "user_id", "left")
            .join(products.select("product_name", "category", "product_risk_tier"),
                  ["product_name", "category"], "left")
            .join(times.select("time_id", "day_name", "is_business_hours"), "time_id", "left"))
