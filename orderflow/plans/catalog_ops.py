"""Registered dashboard, filter, guard, data-quality and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.functions import rules
from orderflow.functions.exact import ratio_round
from orderflow.operators import agent, quality
from orderflow.operators import staging as stg_ops
from orderflow.plans import dashboards as dash
from orderflow.plans import marts
from orderflow.plans import oracle as O
from orderflow.plans.context import OrderContext
from orderflow.plans.catalog_base import register

P = O.PROCESSED
NOW = "(SELECT as_of FROM clock)"


def _w(ctes: str, select: str) -> str:
    return O.with_ctes(ctes, select)


def since(hours: int) -> str:
    return f"timestamp > {NOW} - INTERVAL '{hours}' HOUR"


# -- dashboard panels ---------------------------------------------------------

@register("agg_orders_per_minute", _w(P, f"""
SELECT date_trunc('minute', timestamp) AS minute, count(*) AS order_count
FROM processed WHERE {since(1)} GROUP BY 1"""))
def _per_minute(ctx: OrderContext) -> DataFrame:
    return dash.orders_per_minute(ctx.processed, ctx.as_of)


@register("agg_orders_per_hour", _w(P, f"""
SELECT date_trunc('hour', timestamp) AS time, count(*) AS actual_orders
FROM processed WHERE {since(24)} GROUP BY 1"""))
def _per_hour(ctx: OrderContext) -> DataFrame:
    return dash.orders_per_hour(ctx.processed, ctx.as_of)


@register("agg_revenue_by_category", _w(P, f"""
SELECT category, CAST(sum(amount) AS DECIMAL(18,2)) AS total_revenue
FROM processed WHERE {since(24)} GROUP BY 1"""))
def _rev_cat(ctx: OrderContext) -> DataFrame:
    return dash.revenue_by_category(ctx.processed, ctx.as_of)


@register("top_fraud_feed", _w(P, """
SELECT timestamp, order_id, user_id, amount, orders_per_user_1m, fraud_score, risk_level, reasoning
FROM processed WHERE is_fraud = TRUE ORDER BY timestamp DESC, order_id DESC LIMIT 10"""))
def _feed(ctx: OrderContext) -> DataFrame:
    return dash.fraud_alerts_feed(ctx.processed)


@register("top_products", _w(P, f"""
SELECT product_name, count(*) AS volume FROM processed WHERE {since(6)}
GROUP BY 1 ORDER BY 2 DESC, 1 ASC LIMIT 5"""))
def _top_products(ctx: OrderContext) -> DataFrame:
    return dash.top_products(ctx.processed, ctx.as_of)


@register("top_critical", _w(P, """
SELECT order_id, user_id, amount, fraud_score, timestamp FROM processed
WHERE risk_level = 'CRITICAL' ORDER BY timestamp DESC, order_id DESC LIMIT 3"""))
def _top_critical(ctx: OrderContext) -> DataFrame:
    return dash.top_critical(ctx.processed)


@register("agg_kpi_fraud_rate", _w(P, f"""
SELECT {O.rnd('f * 100', 'n', 2)} AS fraud_rate_pct FROM (
  SELECT {O.cnt_if('is_fraud')} AS f, count(*) AS n FROM processed WHERE {since(1)}) t"""))
def _kpi_rate(ctx: OrderContext) -> DataFrame:
    return dash.kpi_fraud_rate(ctx.processed, ctx.as_of)


@register("agg_kpi_orders", _w(P, f"SELECT count(*) AS total_orders FROM processed WHERE {since(1)}"))
def _kpi_orders(ctx: OrderContext) -> DataFrame:
    return dash.kpi_orders(ctx.processed, ctx.as_of)


@register("agg_kpi_fraud_orders", _w(P, f"""
SELECT count(*) AS fraud_orders FROM processed WHERE is_fraud = TRUE AND {since(1)}"""))
def _kpi_fraud(ctx: OrderContext) -> DataFrame:
    return dash.kpi_fraud_orders(ctx.processed, ctx.as_of)


@register("agg_kpi_revenue", _w(P, f"""
SELECT CAST(sum(amount) AS DECIMAL(18,2)) AS total_revenue FROM processed WHERE {since(24)}"""))
def _kpi_rev(ctx: OrderContext) -> DataFrame:
    return dash.kpi_revenue(ctx.processed, ctx.as_of)


@register("agg_risk_counts", _w(P, f"""
SELECT critical_count, high_count, fraud_count, total_count, total_revenue,
       {O.rnd('fraud_count * 100', 'total_count', 1)} AS fraud_rate_pct FROM (
  SELECT {O.cnt_if("risk_level = 'CRITICAL'")} AS critical_count, {O.cnt_if("risk_level = 'HIGH'")} AS high_count,
         {O.cnt_if('is_fraud')} AS fraud_count, count(*) AS total_count,
         CAST(sum(amount) AS DECIMAL(18,2)) AS total_revenue FROM processed) t"""))
def _risk_counts(ctx: OrderContext) -> DataFrame:
    return dash.risk_counts(ctx.processed)


@register("flt_recent_window", _w(P, f"""
SELECT {O.cnt_if(since(1))} AS orders_1h, {O.cnt_if(since(6))} AS orders_6h,
       {O.cnt_if(since(24))} AS orders_24h, {O.cnt_if(since(720))} AS orders_30d FROM processed"""))
def _recent(ctx: OrderContext) -> DataFrame:
    return dash.recent_windows(ctx.processed, ctx.as_of)


@register("flt_time_band", _w(P, f"""
SELECT order_id, timestamp, amount, category FROM processed
WHERE timestamp > {NOW} - INTERVAL '6' HOUR - INTERVAL '1' DAY AND timestamp < {NOW} + INTERVAL '6' HOUR - INTERVAL '1' DAY"""))
def _band(ctx: OrderContext) -> DataFrame:
    return dash.time_band(ctx.processed, ctx.as_of - F.expr("INTERVAL 1 DAY"))


@register("src_recent_table", _w(P, f"""
SELECT order_id, timestamp, coalesce(amount, order_amount) AS order_amount,
       orders_per_user_1m AS velocity, CAST(is_fraud AS INT) AS is_fraud
FROM processed WHERE {since(24)} AND order_amount > 0"""))
def _recent_table(ctx: OrderContext) -> DataFrame:
    return dash.recent_table(ctx.processed, ctx.as_of)


# -- guard, masking, filters ----------------------------------------------------

RAW_COLS = ("order_id, user_id, product_id, product_name, category, amount, quantity, payment_method, "
            "ip_address, device_type, location_mismatch, account_age_days, shipping_address, checkout_seconds, timestamp, burst_us, "
            "orders_per_user_1m, fraud_score")


@register("flt_valid_orders", _w(O.RAW, f"SELECT {RAW_COLS} FROM raw WHERE {O.GUARD}"))
def _valid(ctx: OrderContext) -> DataFrame:
    return stg_ops.valid_orders(ctx.raw, ctx.as_of)


REJECT_SQL = _w(O.RAW, f"""
SELECT {RAW_COLS.replace("user_id", "sha256('orderflow-' || user_id) AS user_id").replace("ip_address", "sha256('orderflow-' || ip_address) AS ip_address")},
       CASE WHEN NOT coalesce(amount > 0 AND amount < 100000, false) THEN 'NULL_OR_BAD_AMOUNT'
            WHEN user_id IS NULL THEN 'NULL_USER' ELSE 'NULL_OR_FUTURE_TIMESTAMP' END AS reject_reason
FROM raw WHERE NOT {O.GUARD}""")


@register("flt_rejected_orders", REJECT_SQL)
def _rejected(ctx: OrderContext) -> DataFrame:
    return stg_ops.mask_pii(ctx.rejected, ctx.hash_key)


@register("prj_pii_mask", _w(O.RAW, f"""
SELECT order_id, sha256('orderflow-' || user_id) AS user_id,
       sha256('orderflow-' || ip_address) AS ip_address FROM raw WHERE {O.GUARD}"""))
def _mask(ctx: OrderContext) -> DataFrame:
    return stg_ops.mask_pii(stg_ops.valid_orders(ctx.raw, ctx.as_of), ctx.hash_key).select(
        "order_id", "user_id", "ip_address")


@register("flt_fraud_only", _w(O.STG, "SELECT order_id, order_amount, fraud_score, risk_level FROM stg WHERE is_fraud"))
def _fraud_only(ctx: OrderContext) -> DataFrame:
    return ctx.staging.filter(F.col("is_fraud")).select("order_id", "order_amount", "fraud_score", "risk_level")


@register("flt_staging_quality", _w(O.STG.replace(
    "WHERE row_num = 1 AND coalesce(order_amount, amount) > 0 AND coalesce(order_amount, amount) < 100000",
    "WHERE row_num = 1"), """
SELECT order_id, order_amount, order_amount > 0 AND order_amount < 100000 AS passes_amount_check FROM stg"""))
def _stg_quality(ctx: OrderContext) -> DataFrame:
    latest = stg_ops.dedup_latest(
        ctx.processed.select("order_id", "timestamp", "orders_per_user_1m", "fraud_score", "order_amount"),
        "order_id", ["timestamp", "orders_per_user_1m", "fraud_score"])
    amt = F.col("order_amount")
    return latest.select("order_id", amt.alias("order_amount"),
                         ((amt > 0) & (amt < 100000)).alias("passes_amount_check"))


@register("prj_flatten_struct", _w(P, """
SELECT order_id, is_fraud, CAST(fraud_score AS DOUBLE) AS fraud_score, risk_level, reasoning FROM processed"""))
def _flatten(ctx: OrderContext) -> DataFrame:
    scored = ctx.processed.select("order_id", F.struct(
        F.col("is_fraud"), F.col("fraud_score").cast("double").alias("fraud_score"),
        F.col("risk_level"), F.col("reasoning")).alias("fraud_res"))
    return scored.select("order_id", "fraud_res.*")


@register("prj_fill_zero", _w(P + """, uf AS (
  SELECT user_id, count(*) AS fraud_orders FROM processed WHERE risk_level = 'CRITICAL' GROUP BY user_id)""", """
SELECT p.order_id, p.user_id, coalesce(uf.fraud_orders, 0) AS user_critical_orders
FROM processed p LEFT JOIN uf USING (user_id)"""))
def _fill_zero(ctx: OrderContext) -> DataFrame:
    p = ctx.processed
    uf = (p.filter(F.col("risk_level") == "CRITICAL").groupBy("user_id")
           .agg(F.count(F.lit(1)).alias("user_critical_orders")))
    return (p.select("order_id", "user_id").join(uf, "user_id", "left")
             .fillna(0, subset=["user_critical_orders"]))


# -- data tests ---------------------------------------------------------------------

@register("dq_unique_not_null", _w(P, """
SELECT order_id, count(*) AS copies FROM processed GROUP BY order_id
HAVING order_id IS NULL OR count(*) > 1"""))
def _dq_unique(ctx: OrderContext) -> DataFrame:
    return quality.unique_not_null(ctx.processed, "order_id")


# No row of the fixture fails these three, so they run on rows with planted faults:
# orders whose number leaves 0, 1 or 2 when divided by 97.
FAULTY = P + """, faulty AS (
  SELECT * REPLACE (
    CASE CAST(substring(order_id, 5) AS BIGINT) % 97 WHEN 0 THEN 'SEVERE' WHEN 1 THEN NULL ELSE risk_level END AS risk_level,
    CASE CAST(substring(order_id, 5) AS BIGINT) % 97 WHEN 0 THEN fraud_score + 1 WHEN 1 THEN -fraud_score WHEN 2 THEN NULL ELSE fraud_score END AS fraud_score,
    CASE CAST(substring(order_id, 5) AS BIGINT) % 97 WHEN 0 THEN NOT is_fraud WHEN 1 THEN NULL ELSE is_fraud END AS is_fraud)
  FROM processed)"""


def _faulty(ctx: OrderContext) -> DataFrame:
    n = F.substring("order_id", 5, 20).cast("long") % 97
    return ctx.processed.withColumns({
        "risk_level": F.when(n == 0, "SEVERE").when(n == 1, None).otherwise(F.col("risk_level")),
        "fraud_score": F.when(n == 0, F.col("fraud_score") + 1).when(n == 1, -F.col("fraud_score")).when(n == 2, None).otherwise(F.col("fraud_score")),
        "is_fraud": F.when(n == 0, ~F.col("is_fraud")).when(n == 1, None).otherwise(F.col("is_fraud"))})


@register("dq_accepted_values", _w(FAULTY, """
SELECT order_id, risk_level FROM faulty
WHERE risk_level IS NULL OR risk_level NOT IN ('CRITICAL', 'HIGH', 'LOW')"""))
def _dq_values(ctx: OrderContext) -> DataFrame:
    return quality.accepted_values(_faulty(ctx), "risk_level")


@register("dq_score_range", _w(FAULTY, """
SELECT order_id, CAST(fraud_score AS DOUBLE) AS fraud_score FROM faulty WHERE fraud_score IS NULL OR fraud_score < 0 OR fraud_score > 1"""))
def _dq_range(ctx: OrderContext) -> DataFrame:
    return quality.score_in_unit_range(_faulty(ctx)).withColumn("fraud_score", F.col("fraud_score").cast("double"))


@register("dq_label_consistent", _w(FAULTY, """
SELECT order_id, CAST(fraud_score AS DOUBLE) AS fraud_score, is_fraud FROM faulty
WHERE NOT (is_fraud IS NOT DISTINCT FROM (fraud_score > 0.5))"""))
def _dq_label(ctx: OrderContext) -> DataFrame:
    return quality.label_consistent(_faulty(ctx)).withColumn("fraud_score", F.col("fraud_score").cast("double"))


@register("dq_no_future", _w(O.RAW, f"""
SELECT order_id, timestamp FROM raw WHERE timestamp > {NOW}"""))
def _dq_future(ctx: OrderContext) -> DataFrame:
    # Run on the stream input, where the far-future rows are, to show the test catching them.
    return quality.no_future(ctx.raw, ctx.as_of)


# -- rules ---------------------------------------------------------------------------

@register("rule_risk_level", _w(P, """
SELECT order_id, fraud_score,
       CASE WHEN fraud_score > 0.8 THEN 'CRITICAL' WHEN fraud_score > 0.4 THEN 'HIGH' ELSE 'LOW' END AS risk_level
FROM processed"""))
def _risk_level(ctx: OrderContext) -> DataFrame:
    return ctx.processed.select("order_id", "fraud_score", rules.risk_level("fraud_score").alias("risk_level"))


@register("rule_fraud_pattern", _w(O.STG, f"SELECT order_id, {O.FRAUD_PATTERN} AS fraud_pattern FROM stg"))
def _pattern(ctx: OrderContext) -> DataFrame:
    s = ctx.staging
    return s.select("order_id", rules.fraud_pattern("location_mismatch", "orders_per_user_1m", "is_high_value",
                                                    "is_late_night_order").alias("fraud_pattern"))


@register("rule_fraud_pattern_online", _w(P, """
SELECT order_id, CASE WHEN location_mismatch = 1 AND orders_per_user_1m > 5 THEN 'COORDINATED_ATTACK'
  WHEN location_mismatch = 1 AND amount > 1000 THEN 'STOLEN_CARD'
  WHEN orders_per_user_1m > 10 THEN 'BOT_ACTIVITY'
  WHEN amount > 1000 AND hour(timestamp) < 6 THEN 'ACCOUNT_TAKEOVER'
  WHEN location_mismatch = 1 THEN 'LOCATION_FRAUD' ELSE 'ANOMALY' END AS fraud_pattern FROM processed"""))
def _pattern_online(ctx: OrderContext) -> DataFrame:
    p = ctx.processed
    return p.select("order_id", rules.fraud_pattern_online("location_mismatch", "orders_per_user_1m", "amount",
                                                           F.hour("timestamp")).alias("fraud_pattern"))


@register("rule_estimated_loss", _w(O.STG, """
SELECT order_id, CAST(CASE risk_level WHEN 'CRITICAL' THEN order_amount * 0.95 WHEN 'HIGH' THEN order_amount * 0.70
       ELSE order_amount * 0.30 END AS DECIMAL(16,4)) AS estimated_loss_usd FROM stg WHERE is_fraud"""))
def _loss(ctx: OrderContext) -> DataFrame:
    s = ctx.staging.filter(F.col("is_fraud"))
    return s.select("order_id", rules.estimated_loss("risk_level", "order_amount").alias("estimated_loss_usd"))


@register("rule_risk_display", _w(O.STG, """
SELECT order_id, CASE risk_level WHEN 'CRITICAL' THEN '🔴 CRITICAL' WHEN 'HIGH' THEN '🟠 HIGH'
       ELSE '🟡 FLAGGED' END AS risk_display FROM stg"""))
def _display(ctx: OrderContext) -> DataFrame:
    return ctx.staging.select("order_id", rules.risk_display("risk_level").alias("risk_display"))


@register("rule_product_risk_tier", _w(O.DIM_PRODUCTS_CTE,
          "SELECT product_name, category, fraud_rate_pct, product_risk_tier FROM dim_products"))
def _tier(ctx: OrderContext) -> DataFrame:
    return marts.dim_products(ctx.staging, ctx.as_of, ("product_name", "category", "fraud_rate_pct", "product_risk_tier"))


@register("win_rank_in_category", _w(O.DIM_PRODUCTS_CTE,
          "SELECT product_name, category, total_orders, rank_in_category FROM dim_products"))
def _rank_cat(ctx: OrderContext) -> DataFrame:
    return marts.dim_products(ctx.staging, ctx.as_of, ("product_name", "category", "total_orders", "rank_in_category"))


@register("win_rank_overall", _w(O.DIM_PRODUCTS_CTE,
          "SELECT product_name, category, total_revenue_usd, revenue_rank_overall FROM dim_products"))
def _rank_all(ctx: OrderContext) -> DataFrame:
    return marts.dim_products(ctx.staging, ctx.as_of, ("product_name", "category", "total_revenue_usd", "revenue_rank_overall"))


for _name, _cols in (("rule_reputation_score", "reputation_score"), ("rule_user_segment", "user_segment"),
                     ("rule_value_tier", "customer_value_tier")):
    def _mk(cols=_cols):
        def fn(ctx: OrderContext) -> DataFrame:
            return marts.dim_users(ctx.staging, ctx.as_of, cols=("user_id", cols))
        return fn
    register(_name, _w(O.DIM_USERS_CTE, f"SELECT user_id, {_cols} FROM dim_users"))(_mk())


TOP_DRIVERS_SQL = """CASE WHEN orders_per_user_1m > 5 OR location_mismatch = 1 OR amount > 1000 THEN
  list_filter([CASE WHEN orders_per_user_1m > 5 THEN 'High Velocity (' || CAST(orders_per_user_1m AS VARCHAR) || ')' END,
               CASE WHEN location_mismatch = 1 THEN 'Location Mismatch' END,
               CASE WHEN amount > 1000 THEN 'High Ticket Value' END], lambda x: x IS NOT NULL)
  ELSE ['Normal Behavioral Profile'] END"""


@register("rule_top_drivers", _w(P, f"SELECT order_id, {TOP_DRIVERS_SQL} AS top_drivers FROM processed"))
def _drivers(ctx: OrderContext) -> DataFrame:
    p = ctx.processed
    return p.select("order_id", rules.top_drivers("orders_per_user_1m", "location_mismatch", "amount")
                    .alias("top_drivers"))


# -- agent: triage, evidence, decision, final label -----------------------------------

AGENT_CTE = P + """, ipsig AS (
  SELECT ip_address, count(DISTINCT user_id) AS ip_users FROM processed GROUP BY ip_address
), earlier AS (
  SELECT *, count(*) OVER w AS nb, SUM(CAST(is_fraud AS BIGINT)) OVER w AS fb FROM processed
  WINDOW w AS (PARTITION BY ip_address ORDER BY epoch_us(timestamp) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), ain AS (
  SELECT p.order_id, CAST(p.fraud_score AS DOUBLE) AS ens,
         CASE WHEN nb > 0 THEN CAST(fb AS DOUBLE) / CAST(nb AS DOUBLE) ELSE 0.5 END AS gnn,
         s.ip_users > 5 AS is_proxy, p.account_age_days AS age, p.device_type AS dev,
         CAST(count(*) OVER (PARTITION BY p.user_id ORDER BY epoch_us(p.timestamp)
              RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS INT) AS vel,
         p.location_mismatch = 1 AS mis, p.amount,
         p.timestamp AS ts, CAST(CASE WHEN nb > 0 THEN fb ELSE 1 END AS BIGINT) AS f, CASE WHEN nb > 0 THEN nb ELSE 2 END AS n
  FROM earlier p LEFT JOIN ipsig s USING (ip_address)
), agent AS (
  SELECT order_id, ens AS ensemble_score, gnn AS gnn_score,
         CASE WHEN ens > 0.9 AND gnn > 0.9 THEN 'FINAL_BLOCK' WHEN ens < 0.2 AND gnn < 0.2 THEN 'FINAL_APPROVE'
              ELSE 'INVESTIGATE' END AS triage,
         CASE WHEN (ens > 0.9 AND gnn > 0.9) OR (ens < 0.2 AND gnn < 0.2) THEN CAST([] AS VARCHAR[]) ELSE [
           CASE WHEN age < 7 THEN 'WARNING: Account is only ' || CAST(age AS VARCHAR) || ' day(s) old — very new account.'
                WHEN age < 30 THEN 'SIGNAL: Relatively new account (' || CAST(age AS VARCHAR) || ' days). Moderate risk signal.'
                ELSE 'OK: Established account (' || CAST(age AS VARCHAR) || ' days) with prior order history.' END,
           CASE WHEN is_proxy THEN 'WARNING: Transaction originated from a known high-risk proxy or VPN provider.'
                ELSE 'OK: IP address is not associated with proxy or VPN services.' END,
           CASE WHEN dev = 'unknown' THEN 'SIGNAL: Device type is unrecognized or spoofed.'
                ELSE 'OK: Known device type ''' || dev || ''' used for this transaction.' END,
           CASE WHEN vel > 10 THEN 'WARNING: User placed ' || CAST(vel AS VARCHAR) || ' orders in the last hour — extremely high velocity, possible bot activity.'
                WHEN vel > 5 THEN 'SIGNAL: User placed ' || CAST(vel AS VARCHAR) || ' orders in the last hour — elevated velocity.'
                ELSE 'OK: Normal order velocity (' || CAST(vel AS VARCHAR) || ' orders/hour).' END,
           CASE WHEN mis THEN 'WARNING: Billing address location does not match the IP geolocation — possible stolen card or account takeover.'
                ELSE 'OK: Billing location matches IP geolocation.' END] END AS evidence,
         CASE WHEN ens > 0.9 AND gnn > 0.9 THEN 'FINAL_BLOCK' WHEN ens < 0.2 AND gnn < 0.2 THEN 'FINAL_APPROVE'
              WHEN (age < 7 OR is_proxy OR vel > 10 OR mis) AND (ens > 0.5 OR gnn > 0.5) THEN 'FINAL_BLOCK'
              WHEN (age >= 30 OR NOT is_proxy OR dev <> 'unknown' OR vel <= 5 OR NOT mis) AND ens < 0.6 AND gnn < 0.6
                   THEN 'FINAL_APPROVE'
              ELSE 'HUMAN_REVIEW' END AS decision, amount, ts, f, n
  FROM ain
)"""


@register("rule_triage", _w(AGENT_CTE, "SELECT order_id, ensemble_score, gnn_score, triage FROM agent"))
def _triage(ctx: OrderContext) -> DataFrame:
    return agent.investigate(agent.agent_inputs(ctx.processed)).select(
        "order_id", "ensemble_score", "gnn_score", "triage")


@register("rule_evidence", _w(AGENT_CTE, "SELECT order_id, evidence FROM agent"))
def _evidence(ctx: OrderContext) -> DataFrame:
    return agent.investigate(agent.agent_inputs(ctx.processed)).select("order_id", "evidence")


@register("rule_decision", _w(AGENT_CTE, "SELECT order_id, triage, decision FROM agent"))
def _decision(ctx: OrderContext) -> DataFrame:
    return agent.investigate(agent.agent_inputs(ctx.processed)).select("order_id", "triage", "decision")


@register("rule_final_label", _w(AGENT_CTE, """
SELECT order_id, decision, ensemble_score > 0.5 OR decision = 'FINAL_BLOCK' AS final_is_fraud FROM agent"""))
def _final(ctx: OrderContext) -> DataFrame:
    return agent.investigate(agent.agent_inputs(ctx.processed)).select("order_id", "decision", "final_is_fraud")


@register("log_shadow_diff", _w(P + """, ipsig AS (
  SELECT ip_address, count(*) AS n, SUM(CAST(is_fraud AS BIGINT)) AS f FROM processed GROUP BY ip_address)""", f"""
SELECT p.order_id, CAST(p.fraud_score AS DECIMAL(10,4)) AS champion_score,
       {O.rnd('s.f', 's.n', 4)} AS challenger_score,
       {O.rnd(f"abs({O.units('p.fraud_score', 4)} * s.n - s.f * 10000)", 's.n * 10000', 4)} AS score_diff
FROM processed p JOIN ipsig s USING (ip_address)"""))
def _shadow(ctx: OrderContext) -> DataFrame:
    p = ctx.processed
    sig = agent.ip_signals(p).select("ip_address", F.col("ip_orders").alias("n"),
                                     F.col("ip_fraud_orders").alias("f"))
    j = p.join(sig, "ip_address")
    units = (F.col("fraud_score") * 10000).cast("long")
    return j.select("order_id", F.col("fraud_score").cast("decimal(10,4)").alias("champion_score"),
                    ratio_round("f", "n", 4).alias("challenger_score"),
                    ratio_round(F.abs(units * F.col("n") - F.col("f") * 10000), F.col("n") * 10000, 4)
                    .alias("score_diff"))


@register("feed_alerts", _w(P, """
SELECT order_id, risk_level, CAST(to_json(struct_pack(username := 'orderflow', icon_emoji := ':shield:', attachments := [struct_pack(
  fallback := '🚨 ' || risk_level || ' FRAUD DETECTED: ' || order_id,
  color := CASE risk_level WHEN 'CRITICAL' THEN '#ff0000' ELSE '#ffa500' END,
  title := '🚨 ' || risk_level || ' Risk Fraud Detected',
  fields := [struct_pack(title := 'Order ID', value := order_id, short := true),
             struct_pack(title := 'Fraud Score', value := CAST(CAST(fraud_score AS DECIMAL(10,4)) AS VARCHAR), short := true),
             struct_pack(title := 'Risk Level', value := risk_level, short := true),
             struct_pack(title := 'Reasoning', value := reasoning, short := false)],
  footer := 'orderflow', ts := epoch_us(timestamp) // 1000000)])) AS VARCHAR) AS payload
FROM processed WHERE risk_level IN ('CRITICAL', 'HIGH')"""))
def _alerts(ctx: OrderContext) -> DataFrame:
    return agent.alerts(ctx.processed)


@register("feed_blocklist", _w(P, """
SELECT ip_address, max(timestamp) AS blocked_at, max(timestamp) + INTERVAL '24' HOUR AS expires_at
FROM processed WHERE risk_level = 'CRITICAL' GROUP BY ip_address"""))
def _blocklist(ctx: OrderContext) -> DataFrame:
    return agent.blocklist(ctx.processed)


@register("jn_blocklist_anti", _w(P, """
SELECT o.order_id, o.ip_address, o.timestamp FROM processed o
WHERE NOT EXISTS (SELECT 1 FROM processed c WHERE c.ip_address = o.ip_address AND c.risk_level = 'CRITICAL'
                  AND c.timestamp < o.timestamp AND o.timestamp < c.timestamp + INTERVAL '24' HOUR)"""))
def _anti(ctx: OrderContext) -> DataFrame:
    return agent.drop_blocked(ctx.processed).select("order_id", "ip_address", "timestamp")
