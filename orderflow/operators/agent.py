"""Investigation signals and the rule-based triage agent, on every row.

The evaluator -> researcher -> reasoner steps become three column
expressions. Graph and velocity signals come from aggregates joined back by
key (IP or user), never from pairs of orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.functions import rules
from orderflow.operators.common import join_null_safe
from orderflow.operators.ranking import cumulative_by_value
from orderflow.operators.velocity import trailing_count

HOUR_US = 3_600_000_000
# A proxy/VPN exit shows up as one IP used by many distinct users.
PROXY_MIN_USERS = 5


def ip_signals(orders: DataFrame, ip_col: str = "ip_address") -> DataFrame:
    """Per IP: orders, fraud orders, distinct users (one aggregate, map-side combined)."""
    return orders.groupBy(ip_col).agg(
        F.count(F.lit(1)).alias("ip_orders"),
        F.sum(F.col("is_fraud").cast("long")).alias("ip_fraud_orders"),
        F.countDistinct("user_id").alias("ip_users"),
    )


# Share of an IP without earlier orders: one in two.
NO_HISTORY = (1, 2)


def with_ring_score(orders: DataFrame, ip_col: str = "ip_address", ts_col: str = "timestamp") -> DataFrame:
    """``gnn_score`` = fraud share of the earlier orders from the same IP (0.5 where there are none), as
    ``ip_fraud_orders`` / ``ip_orders``; ``is_proxy`` flag. Neither the order's own label nor a
    later one counts. An IP's orders are counted over ranges of time, so a third of
    all rows from one IP is many tasks."""
    us = orders.withColumn("__us", F.unix_micros(F.col(ts_col)))
    past = cumulative_by_value(us.select(ip_col, "__us", "is_fraud"), [ip_col], "__us", {"n": F.lit(1), "f": F.col("is_fraud").cast("int")}, descending=False)
    some = F.col("n_beyond") > 0
    past = past.select(ip_col, "__us", F.when(some, F.coalesce("f_beyond", F.lit(0))).otherwise(NO_HISTORY[0]).cast("long").alias("ip_fraud_orders"),
                       F.when(some, F.col("n_beyond")).otherwise(NO_HISTORY[1]).cast("long").alias("ip_orders"))
    users = ip_signals(orders, ip_col).select(ip_col, "ip_users")
    return (join_null_safe(us, past, [ip_col, "__us"], "left").drop("__us").join(users, ip_col, "left")
            .withColumn("gnn_score", F.col("ip_fraud_orders").cast("double") / F.col("ip_orders").cast("double"))
            .withColumn("is_proxy", F.col("ip_users") > PROXY_MIN_USERS))


def with_orders_last_hour(orders: DataFrame, key: str = "user_id", ts_col: str = "timestamp",
                          out_col: str = "orders_last_hour") -> DataFrame:
    """Trailing one-hour count per user on event time, ``(t - 1h, t]``."""
    us = orders.withColumn("__us", F.unix_micros(F.col(ts_col)))
    out = trailing_count(us, [key], "__us", HOUR_US - 1, out_col)
    return out.withColumn(out_col, F.col(out_col).cast("int")).drop("__us")


def investigate(orders: DataFrame) -> DataFrame:
    """Triage, evidence and decision for every order.

    Expects: order_id, fraud_score, gnn_score, account_age_days, is_proxy,
    device_type, orders_last_hour, location_mismatch.
    """
    ens = F.col("fraud_score").cast("double")
    gnn = F.col("gnn_score")
    tri = rules.triage(ens, gnn)
    ev = rules.evidence(F.col("account_age_days"), F.col("is_proxy"), F.col("device_type"),
                        F.col("orders_last_hour"), F.col("location_mismatch").cast("boolean"))
    investigated = tri == "INVESTIGATE"
    evidence = F.when(investigated, ev).otherwise(F.array().cast("array<string>"))
    dec = F.when(investigated, rules.decision(ev, ens, gnn)).otherwise(tri)
    return orders.select(
        "order_id", ens.alias("ensemble_score"), gnn.alias("gnn_score"),
        tri.alias("triage"), evidence.alias("evidence"), dec.alias("decision"),
        rules.final_label(ens, F.lit(rules.FRAUD_SCORE_THRESHOLD), dec).alias("final_is_fraud"),
        "amount",
    )


def agent_inputs(processed: DataFrame) -> DataFrame:
    return with_orders_last_hour(with_ring_score(processed))


def blocklist(processed: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """IPs with a CRITICAL order, the latest block time and its expiry."""
    return (processed.filter(F.col("risk_level") == "CRITICAL")
            .groupBy("ip_address").agg(F.max("timestamp").alias("blocked_at"))
            .withColumn("expires_at", F.col("blocked_at") + F.expr(f"INTERVAL {ttl_hours} HOURS")))


def drop_blocked(processed: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """Orders whose IP had no CRITICAL order in the preceding ``ttl_hours``.

    A block placed at ``b`` covers ``b <= t < b + ttl`` and is placed after the
    triggering order is scored, so only strictly earlier CRITICAL orders
    count. Computed as a keyed trailing count of CRITICAL rows (no join, no
    per-IP partition).
    """
    us = (processed.withColumn("__us", F.unix_micros("timestamp"))
                   .withColumn("__crit", (F.col("risk_level") == "CRITICAL").cast("long")))
    width = ttl_hours * HOUR_US - 1
    counted = trailing_count(us, ["ip_address"], "__us", width, "__blocks", weight="__crit", strict=True, sub_buckets=12)
    return counted.filter(F.col("__blocks") == 0).drop("__us", "__crit", "__blocks")


# Fixed values of an alert: names, colours, titles of its fields.
ALERT_NAME, ALERT_ICON = "orderflow", ":shield:"
ALERT_COLOURS = {"CRITICAL": "#ff0000", "HIGH": "#ffa500"}
ALERT_TITLE, ALERT_FALLBACK = "🚨 %s Risk Fraud Detected", "🚨 %s FRAUD DETECTED: %s"
ALERT_FIELDS = ("Order ID", "Fraud Score", "Risk Level", "Reasoning")


def alerts(processed: DataFrame) -> DataFrame:
    """CRITICAL / HIGH rows as chat messages (JSON text) with one attachment and its fields."""
    hot = processed.filter(F.col("risk_level").isin(*ALERT_COLOURS))
    values = (F.col("order_id"), F.col("fraud_score").cast("decimal(10,4)").cast("string"), F.col("risk_level"), F.col("reasoning"))
    fields = [F.struct(F.lit(t).alias("title"), v.alias("value"), F.lit(t != "Reasoning").alias("short")) for t, v in zip(ALERT_FIELDS, values)]
    attachment = F.struct(
        F.format_string(ALERT_FALLBACK, "risk_level", "order_id").alias("fallback"),
        F.when(F.col("risk_level") == "CRITICAL", ALERT_COLOURS["CRITICAL"]).otherwise(ALERT_COLOURS["HIGH"]).alias("color"),
        F.format_string(ALERT_TITLE, "risk_level").alias("title"), F.array(*fields).alias("fields"),
        F.lit(ALERT_NAME).alias("footer"), F.unix_seconds("timestamp").alias("ts"))
    payload = F.to_json(F.struct(F.lit(ALERT_NAME).alias("username"), F.lit(ALERT_ICON).alias("icon_emoji"), F.array(attachment).alias("attachments")))
    return hot.select("order_id", "risk_level", payload.alias("payload"))
