"""Registered streaming, sink, source, set, window and remaining aggregate queries."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.functions.exact import ratio_round
from orderflow.functions.scalars import one_row
from orderflow.operators import agent, drift, evaluation
from orderflow.operators import staging as stg_ops
from orderflow.operators.aggregates import count_if, mode_smallest
from orderflow.operators.stats import group_median
from orderflow.operators.velocity import attach_sliding_velocity, sliding_window_counts
from orderflow.plans import marts
from orderflow.plans import oracle as O
from orderflow.operators import forecast as fc
from orderflow.plans.catalog_forecast import FORECAST_CTE, demand_forecast
from orderflow.plans.catalog_ml import EVAL_CTE, FEAT_CTE, LONG_CTE, feature_frame, kept_long_features, scored_frame
from orderflow.plans.catalog_ops import AGENT_CTE
from orderflow.plans.context import OrderContext
from orderflow.plans.catalog_base import register
from orderflow.session import cut_lineage
from orderflow.sources import ingest, sinks
from orderflow.streaming import order_stream

P = O.PROCESSED
NOW = "(SELECT as_of FROM clock)"


def _w(ctes: str, select: str) -> str:
    return O.with_ctes(ctes, select)


def run_root(ctx: OrderContext, name: str) -> str:
    """A fresh folder under the shared checkpoint location for one run."""
    return sinks.shared_path(ctx.spark, "runs", f"{name}-{uuid.uuid4().hex[:12]}")


def replay_source(ctx: OrderContext, root: str) -> str:
    """The stream input for a replay: raw orders as JSON lines (written by Spark)."""
    path = os.path.join(root, "source")
    ingest.encode_orders(ctx.raw).write.mode("overwrite").text(path)
    return path


def stream_outputs(ctx: OrderContext, name: str) -> order_stream.StreamOutputs:
    root = run_root(ctx, name)
    src = replay_source(ctx, root)
    return order_stream.run_available(ctx.spark, src, root, key=ctx.hash_key)


# -- sources ------------------------------------------------------------------------

DECODED_SQL = _w(O.RAW, """
SELECT order_id, user_id, product_id, product_name, category, CAST(amount AS DOUBLE) AS amount, quantity,
       payment_method, ip_address, device_type, location_mismatch, timestamp FROM raw""")


@register("src_json_decode", DECODED_SQL)
def _decode(ctx: OrderContext) -> DataFrame:
    return ingest.decode_orders(ingest.encode_orders(ctx.raw))


@register("src_order_stream", DECODED_SQL)
def _order_stream(ctx: OrderContext) -> DataFrame:
    root = run_root(ctx, "src-stream")
    src = replay_source(ctx, root)
    decoded = ingest.decode_orders(ingest.file_order_stream(ctx.spark, src))
    out = os.path.join(root, "decoded")
    q = (decoded.writeStream.format("parquet").option("checkpointLocation", os.path.join(root, "_ckpt"))
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return ctx.spark.read.parquet(out)


STG_TX = O.staging("product_id, quantity, payment_method, account_age_days, ip_address")


def _tx_layout(ctx: OrderContext) -> DataFrame:
    stg = stg_ops.staging_orders(ctx.processed, extra=("product_id", "quantity", "payment_method",
                                                       "account_age_days", "ip_address"))
    return ingest.transactions_layout(stg)


@register("src_transactions_csv", _w(STG_TX, """
SELECT order_id AS "Transaction ID", user_id AS "Customer ID", CAST(order_amount AS DOUBLE) AS "Transaction Amount",
       order_timestamp AS "Transaction Date", payment_method AS "Payment Method",
       category AS "Product Category", quantity AS "Quantity", CAST(NULL AS INT) AS "Customer Age",
       CAST(NULL AS VARCHAR) AS "Customer Location", device_type AS "Device Used", ip_address AS "IP Address",
       'USA' AS "Shipping Address", CASE WHEN location_mismatch THEN 'mismatch' ELSE 'USA' END AS "Billing Address",
       account_age_days AS "Account Age Days", CAST(hour(order_timestamp) AS INT) AS "Transaction Hour",
       CAST(is_fraud AS INT) AS "Is Fraudulent" FROM stg"""))
def _tx_csv(ctx: OrderContext) -> DataFrame:
    path = os.path.join(run_root(ctx, "tx-csv"), "transactions")
    _tx_layout(ctx).write.mode("overwrite").option("header", "true").option("timestampFormat", ingest.CSV_TIMESTAMP).csv(path)
    return ingest.read_transactions_csv(ctx.spark, path)


MAP_COLS = ("order_id", "user_id", "order_amount", "device_type", "payment_method", "category", "is_fraud",
            "account_age_days", "transaction_hour", "location_mismatch")


@register("prj_schema_map", _w(STG_TX, """
SELECT order_id, user_id, CAST(order_amount AS DOUBLE) AS order_amount, device_type, payment_method, category,
       CAST(is_fraud AS INT) AS is_fraud, account_age_days, CAST(hour(order_timestamp) AS INT) AS transaction_hour,
       CAST(location_mismatch AS INT) AS location_mismatch FROM stg"""))
def _schema_map(ctx: OrderContext) -> DataFrame:
    return ingest.map_transaction_schema(_tx_layout(ctx)).select(*MAP_COLS)


@register("prj_location_mismatch", _w(STG_TX, """
SELECT order_id, CASE WHEN location_mismatch THEN 'mismatch' ELSE 'USA' END AS billing_address,
       CAST(location_mismatch AS INT) AS location_mismatch FROM stg"""))
def _loc_mismatch(ctx: OrderContext) -> DataFrame:
    tx = _tx_layout(ctx)
    return ingest.map_transaction_schema(tx).select("order_id", F.col("Billing Address").alias("billing_address"),
                                                    "location_mismatch")


# -- streaming: replays of one batch of files ------------------------------------------

# Accepted orders (the fixture repeats an order only a second later, so the first of
# an id is the accepted one), their velocity and score, and whether their windows have closed.
STREAM_CTE = O.RAW + f""", judged AS (
  SELECT *, CASE WHEN NOT coalesce(amount > 0 AND amount < 100000, false) THEN 'NULL_OR_BAD_AMOUNT'
                 WHEN user_id IS NULL THEN 'NULL_USER'
                 WHEN NOT coalesce(timestamp <= CAST(now() AS TIMESTAMP), false) THEN 'NULL_OR_FUTURE_TIMESTAMP'
                 WHEN order_id IS NULL OR product_id IS NULL OR category IS NULL THEN 'MISSING_FIELD' END AS reject_reason
  FROM raw
), accepted AS (
  SELECT * EXCLUDE (orders_per_user_1m, fraud_score), epoch_us(timestamp) // 30000000 AS s FROM judged
  WHERE reject_reason IS NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY timestamp) = 1
), wins AS (
  SELECT user_id, ws, count(*) AS n FROM (
    SELECT user_id, s AS ws FROM accepted UNION ALL SELECT user_id, s - 1 FROM accepted) t GROUP BY user_id, ws
), counted AS (
  SELECT a.*, CAST((SELECT max(n) FROM wins w WHERE w.user_id = a.user_id AND w.ws IN (a.s, a.s - 1)) AS INT) AS orders_per_user_1m
  FROM accepted a
), st AS (
  SELECT order_id, sha256('orderflow-' || user_id) AS user_id, CAST(amount AS DOUBLE) AS amount, category, timestamp,
         CAST(timestamp AS DATE) AS order_date, orders_per_user_1m,
         round(least(CAST(1 AS DOUBLE), CAST(0.05 AS DOUBLE) + CAST(0.25 AS DOUBLE) * location_mismatch
           + CASE WHEN amount > 1000 THEN CAST(0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
           + CASE WHEN hour(timestamp) BETWEEN 0 AND 5 THEN CAST(0.10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
           + CAST(0.03 AS DOUBLE) * least(orders_per_user_1m, 10)), 4) AS fraud_score,
         {O.REASONING} AS reasoning, (s + 2) * 30000000 AS closes_us,
         (s + 2) * 30000000 <= (SELECT max(epoch_us(timestamp)) FROM judged WHERE reject_reason IS NULL) - 60000000 AS closed
  FROM counted
)"""


@register("stream_score", _w(STREAM_CTE, """
SELECT order_id, user_id, amount, timestamp, orders_per_user_1m, fraud_score > 0.5 AS is_fraud, fraud_score,
       CASE WHEN fraud_score > 0.8 THEN 'CRITICAL' WHEN fraud_score > 0.4 THEN 'HIGH' ELSE 'LOW' END AS risk_level, reasoning
FROM st"""))
def _stream_score(ctx: OrderContext) -> DataFrame:
    return stream_outputs(ctx, "score").table_rows(ctx.spark).select(
        "order_id", "user_id", "amount", "timestamp", "orders_per_user_1m", "is_fraud", "fraud_score", "risk_level", "reasoning")


@register("stream_velocity", _w(STREAM_CTE, "SELECT order_id, user_id, timestamp, orders_per_user_1m FROM st"))
def _stream_velocity(ctx: OrderContext) -> DataFrame:
    return stream_outputs(ctx, "velocity").table_rows(ctx.spark).select("order_id", "user_id", "timestamp", "orders_per_user_1m")


@register("stream_guard_split", _w(STREAM_CTE, """
SELECT order_id, sha256('orderflow-' || user_id) AS user_id, product_id, product_name, category, CAST(amount AS DOUBLE) AS amount,
       quantity, payment_method, sha256('orderflow-' || ip_address) AS ip_address, device_type, location_mismatch, timestamp, reject_reason
FROM judged WHERE reject_reason IS NOT NULL"""))
def _stream_guard(ctx: OrderContext) -> DataFrame:
    return stream_outputs(ctx, "guard").dead_rows(ctx.spark).drop("batch_id", "order_date")


@register("stream_multi_sink", _w(STREAM_CTE, """
SELECT 'table' AS sink, order_date, count(*) AS rows FROM st GROUP BY order_date
UNION ALL SELECT 'archive', order_date, count(*) FROM st WHERE closed GROUP BY order_date
UNION ALL SELECT 'dead_letter', CAST(timestamp AS DATE), count(*) FROM judged WHERE reject_reason IS NOT NULL GROUP BY 2"""))
def _stream_multi(ctx: OrderContext) -> DataFrame:
    out = stream_outputs(ctx, "multi")
    parts = [df.groupBy("order_date").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("sink"), "order_date", "rows")
             for name, df in (("table", out.table_rows(ctx.spark)), ("archive", out.archive_rows(ctx.spark)), ("dead_letter", out.dead_rows(ctx.spark)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("stream_watermark", _w(STREAM_CTE, """
SELECT order_id, make_timestamp(closes_us) AS window_end, orders_per_user_1m FROM st WHERE closed"""))
def _stream_watermark(ctx: OrderContext) -> DataFrame:
    rows = stream_outputs(ctx, "watermark").archive_rows(ctx.spark)
    return rows.select("order_id", F.timestamp_micros(order_stream.window_end_us()).alias("window_end"), "orders_per_user_1m")


STREAM_VALID = O.RAW + """, v AS (
  SELECT * FROM raw WHERE coalesce(amount > 0 AND amount < 100000 AND user_id IS NOT NULL
                                   AND timestamp <= CAST(now() AS TIMESTAMP), false)
), sl AS (
  SELECT user_id, CAST(floor(epoch_us(timestamp) / 30000000) AS BIGINT) AS s FROM v
), w AS (
  SELECT user_id, ws, count(*) AS n FROM (SELECT user_id, s AS ws FROM sl UNION ALL SELECT user_id, s - 1 FROM sl) t
  GROUP BY user_id, ws
)"""


# One availableNow batch, then a no-data batch at watermark = max event time - 1 minute:
# exactly the windows ending at or before the watermark have been emitted.
@register("stream_sliding_count", O.with_ctes(STREAM_VALID, """
SELECT make_timestamp(ws * 30000000) AS window_start, make_timestamp(ws * 30000000 + 60000000) AS window_end,
       user_id, n AS orders_per_user_1m FROM w
WHERE make_timestamp(ws * 30000000 + 60000000) <= (SELECT max(timestamp) FROM v) - INTERVAL 1 MINUTE"""))
def _stream_sliding(ctx: OrderContext) -> DataFrame:
    root = run_root(ctx, "sliding")
    return order_stream.run_sliding_counts(ctx.spark, replay_source(ctx, root), root)


@register("stream_idempotent", _w(STREAM_CTE, "SELECT order_id, 1 AS versions FROM st"))
def _stream_idem(ctx: OrderContext) -> DataFrame:
    rows = stream_outputs(ctx, "idem").table_rows(ctx.spark)
    return rows.groupBy("order_id").agg(F.count(F.lit(1)).cast("int").alias("versions"))


BATCH_ROWS = _w(STREAM_CTE, "SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS rows FROM st WHERE closed")


@register("stream_checkpoint", BATCH_ROWS)
def _stream_ckpt(ctx: OrderContext) -> DataFrame:
    root = run_root(ctx, "ckpt")
    src = replay_source(ctx, root)
    order_stream.run_available(ctx.spark, src, root, key=ctx.hash_key)
    out = order_stream.run_available(ctx.spark, src, root, key=ctx.hash_key)  # restart: nothing new to read
    return out.archive_rows(ctx.spark).groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))


@register("snk_foreach_batch", BATCH_ROWS)
def _snk_batch(ctx: OrderContext) -> DataFrame:
    return stream_outputs(ctx, "foreach").archive_rows(ctx.spark).groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))


@register("snk_lake_archive", _w(STREAM_CTE, "SELECT order_date, count(*) AS rows FROM st WHERE closed GROUP BY order_date"))
def _snk_archive(ctx: OrderContext) -> DataFrame:
    return stream_outputs(ctx, "archive").archive_rows(ctx.spark).groupBy("order_date").agg(F.count(F.lit(1)).alias("rows"))


@register("snk_console_preview", _w(P, "SELECT * FROM processed"))
def _snk_console(ctx: OrderContext) -> DataFrame:
    # The console sink prints the scored stream; this is what it prints.
    return ctx.processed


@register("snk_dead_letter", _w(O.RAW, f"""
SELECT order_id, amount, sha256('orderflow-' || user_id) AS user_id, timestamp,
       CASE WHEN NOT coalesce(amount > 0 AND amount < 100000, false) THEN 'NULL_OR_BAD_AMOUNT'
            WHEN user_id IS NULL THEN 'NULL_USER' ELSE 'NULL_OR_FUTURE_TIMESTAMP' END AS reject_reason
FROM raw WHERE NOT {O.GUARD}"""))
def _snk_dead(ctx: OrderContext) -> DataFrame:
    path = os.path.join(run_root(ctx, "deadletter"), "dead_letter")
    dead = stg_ops.mask_pii(ctx.rejected, ctx.hash_key).withColumn("order_date", F.to_date("timestamp"))
    sinks.write_partitions(dead, path, 0)
    return sinks.read_table(ctx.spark, path).select("order_id", "amount", "user_id", "timestamp", "reject_reason")


FEEDBACK_CTE = AGENT_CTE + """, feedback AS (
  SELECT order_id, ensemble_score > 0.5 AS model_prediction, decision = 'FINAL_BLOCK' AS actual_label
  FROM agent WHERE triage = 'INVESTIGATE' AND decision <> 'HUMAN_REVIEW'
)"""


def feedback_rows(ctx: OrderContext) -> DataFrame:
    inv = agent.investigate(agent.agent_inputs(ctx.processed))
    return inv.filter((F.col("triage") == "INVESTIGATE") & (F.col("decision") != "HUMAN_REVIEW")).select(
        "order_id", (F.col("ensemble_score") > 0.5).alias("model_prediction"),
        (F.col("decision") == "FINAL_BLOCK").alias("actual_label"))


# The evaluation and the drift of one model version, in one statement: the feature CTEs go after the agent's.
PERFORMANCE_CTE = (EVAL_CTE + ", " + LONG_CTE[LONG_CTE.index("dedup AS ("):] + FEEDBACK_CTE[len(AGENT_CTE):] + """, perf AS (
  SELECT (SELECT SUM(CAST(pos_eq AS DOUBLE) / CAST(p_tot AS DOUBLE) * (CAST(tps AS DOUBLE) / CAST(tps + fps AS DOUBLE))) FROM cum) AS pr_auc,
         CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision_score,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall_score,
         CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1_score,
         (SELECT CASE WHEN n_current >= 50 THEN drift_share ELSE 0.0 END FROM share) AS drift_score,
         (SELECT CAST(n_current >= 50 AND dataset_drift AS INT) FROM share) AS drift_detected
  FROM (SELECT SUM(CASE WHEN y_score >= t AND y_true = 0 THEN 1 ELSE 0 END) AS fp,
               SUM(CASE WHEN y_score < t AND y_true = 1 THEN 1 ELSE 0 END) AS fn,
               SUM(CASE WHEN y_score >= t AND y_true = 1 THEN 1 ELSE 0 END) AS tp
        FROM ev, (SELECT threshold AS t FROM best_cost) b) c
)""")
METRICS = ("pr_auc", "f1_score", "precision_score", "recall_score", "drift_score", "drift_detected")


def performance_rows(ctx: OrderContext) -> DataFrame:
    """One row of the performance log: the evaluation at the cheapest threshold, and the drift of the features."""
    evaluated = scored_frame(ctx)
    auc = one_row(evaluation.pr_roc_auc(evaluated))
    best = one_row(evaluation.best_cost_threshold(evaluated).select("threshold")).threshold
    hit = one_row(evaluation.confusion(evaluated, F.lit(best)))
    gate = one_row(drift.gate(drift.drift_share(drift.column_drift(kept_long_features(ctx)))))
    values = (auc.pr_auc, hit.f1, hit.precision, hit.recall, gate.drift_score, int(gate.drift_detected))
    return ctx.spark.createDataFrame([("ensemble_champion", "current", *map(float, values))], "model_name string, model_version string, " + ", ".join(f"{m} double" for m in METRICS))


@register("snk_event_logs", _w(PERFORMANCE_CTE, f"""
SELECT 'shadow' AS log, order_id AS key, 'champion_score' AS measure, CAST(fraud_score AS DECIMAL(18,4)) AS value FROM processed
UNION ALL SELECT 'shadow', order_id, 'challenger_score', CAST({O.rnd('f', 'n', 4)} AS DECIMAL(18,4)) FROM agent
UNION ALL SELECT 'shadow', order_id, 'score_diff', CAST({O.rnd("abs(CAST(round(ensemble_score * 10000) AS BIGINT) * n - f * 10000)", 'n * 10000', 4)} AS DECIMAL(18,4)) FROM agent
UNION ALL SELECT 'features', order_id, 'amount', CAST(amount AS DECIMAL(18,4)) FROM processed
UNION ALL SELECT 'feedback', order_id, 'actual_label', CAST(CAST(actual_label AS INT) AS DECIMAL(18,4)) FROM feedback
{' '.join(f"UNION ALL SELECT 'performance', 'ensemble_champion', '{m}', CAST(round({m}, 4) AS DECIMAL(18,4)) FROM perf" for m in METRICS)}"""))
def _snk_logs(ctx: OrderContext) -> DataFrame:
    root = run_root(ctx, "logs")
    p = ctx.processed
    units = (F.col("fraud_score") * 10000).cast("long")
    shadow = agent.with_ring_score(p).select(
        "timestamp", "order_id", F.col("fraud_score").alias("champion_score"),
        ratio_round("ip_fraud_orders", "ip_orders", 4).alias("challenger_score"),
        ratio_round(F.abs(units * F.col("ip_orders") - F.col("ip_fraud_orders") * 10000), F.col("ip_orders") * 10000, 4).alias("score_diff"))
    inputs = p.select("timestamp", "order_id", "amount", "orders_per_user_1m", "location_mismatch", "device_type", "fraud_score")
    logs = {"shadow": (shadow, "order_id", ("champion_score", "challenger_score", "score_diff")), "features": (inputs, "order_id", ("amount",)),
            "feedback": (feedback_rows(ctx), "order_id", ("actual_label",)), "performance": (performance_rows(ctx), "model_name", METRICS)}
    out = None
    for name, (rows, key, measures) in logs.items():
        path = os.path.join(root, name)
        sinks.append_log(rows, path)
        number = lambda c: (F.col(c).cast("int") if c == "actual_label" else F.round(F.col(c), 4)).cast("decimal(18,4)")
        each = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), number(m).alias("value")) for m in measures]))
        back = ctx.spark.read.parquet(path).select(F.lit(name).alias("log"), F.col(key).alias("key"), each)
        out = back if out is None else out.unionByName(back)
    return out


@register("snk_reference_sample", _w(FEAT_CTE, f"""
SELECT order_id, CAST(is_fraud AS VARCHAR) AS is_fraud, CAST(order_hour AS VARCHAR) AS order_hour FROM feat
WHERE split = 'train' QUALIFY row_number() OVER (ORDER BY md5(order_id), order_id) <= 5000"""))
def _snk_ref(ctx: OrderContext) -> DataFrame:
    path = os.path.join(run_root(ctx, "refsample"), "reference_data")
    train = feature_frame(ctx).filter(F.col("split") == "train")
    sinks.reference_sample(train, "order_id").drop("split").write.mode("overwrite") \
         .option("header", "true").csv(path)
    back = ctx.spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    return back.select("order_id", "is_fraud", "order_hour")


MODELS_CTE = (FORECAST_CTE + ", " + O.FRAUD_DAILY_CTE[O.FRAUD_DAILY_CTE.index("daily AS ("):]
              + ", " + O.DIM_USERS_CTE[O.DIM_USERS_CTE.index("ustats AS ("):]
              + ", " + O.DIM_PRODUCTS_CTE[O.DIM_PRODUCTS_CTE.index("pstats AS ("):]
              + ", " + re.sub(r"\b(tb|spine)\b", r"dt_\1", O.DIM_TIME_CTE[O.DIM_TIME_CTE.index("tb AS ("):]))
# Each model with a measure that its contents must add up to.
MODEL_MEASURES = {"stg_orders": "order_amount", "demand_forecast": "predicted_orders", "fct_fraud_orders": "estimated_loss_usd",
                  "dim_products": "total_revenue_usd", "dim_users": "total_spend_usd", "fct_fraud_daily_summary": "fraud_rate_pct",
                  "fct_forecast_vs_actuals": "actual_orders", "dim_time": "time_id", "fact_orders": "order_amount"}


@register("mat_views_tables", _w(MODELS_CTE, f"""
SELECT 'stg_orders' AS model, count(*) AS rows, CAST(sum(order_amount) AS DECIMAL(20,4)) AS total FROM stg
UNION ALL SELECT 'demand_forecast', count(*), CAST(sum(predicted_orders) AS DECIMAL(20,4)) FROM demand_forecast
UNION ALL SELECT 'fct_fraud_orders', count(*), CAST(sum(estimated_loss_usd) AS DECIMAL(20,4)) FROM ({O.FCT_FRAUD_ORDERS_SELECT}) f
UNION ALL SELECT 'dim_products', count(*), CAST(sum(total_revenue_usd) AS DECIMAL(20,4)) FROM dim_products
UNION ALL SELECT 'dim_users', count(*), CAST(sum(total_spend_usd) AS DECIMAL(20,4)) FROM dim_users
UNION ALL SELECT 'fct_fraud_daily_summary', count(*), CAST(sum(fraud_rate_pct) AS DECIMAL(20,4)) FROM daily2
UNION ALL SELECT 'fct_forecast_vs_actuals', count(*), CAST(sum(actual_orders) AS DECIMAL(20,4)) FROM fva
UNION ALL SELECT 'dim_time', count(*), CAST(sum(time_id) AS DECIMAL(20,4)) FROM dim_time
UNION ALL SELECT 'fact_orders', count(*), CAST(sum(order_amount) AS DECIMAL(20,4)) FROM stg"""))
def _mat(ctx: OrderContext) -> DataFrame:
    table, as_of = ctx.spark.table, ctx.as_of
    plus = cut_lineage(stg_ops.staging_orders(ctx.processed, extra=("product_id", "quantity", "payment_method")))
    run = uuid.uuid4().hex[:12]
    name = lambda model: f"{model}_{run}"  # noqa: E731  a run's own tables
    stg = lambda: table(name("stg_orders"))
    built = sinks.materialize_views({
        name("stg_orders"): lambda: plus.drop("product_id", "quantity", "payment_method"),
        name("demand_forecast"): lambda: demand_forecast(ctx),
        name("dim_time"): lambda: marts.dim_time(stg()),
        name("dim_products"): lambda: marts.dim_products(stg(), as_of),
        name("dim_users"): lambda: marts.dim_users(stg(), as_of),
        name("fct_fraud_orders"): lambda: marts.fct_fraud_orders(stg(), as_of),
        name("fct_fraud_daily_summary"): lambda: marts.fraud_daily(stg(), as_of),
        name("fct_forecast_vs_actuals"): lambda: fc.forecast_vs_actuals(fc.hourly_actuals(stg()), table(name("demand_forecast"))),
        name("fact_orders"): lambda: marts.fact_orders(plus),
    }, views=(name("stg_orders"),), location=run_root(ctx, "warehouse"))
    out = None
    for model, measure in MODEL_MEASURES.items():
        part = built[name(model)].agg(F.lit(model).alias("model"), F.count(F.lit(1)).alias("rows"), F.sum(measure).cast("decimal(20,4)").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


# -- sets, sampling, ordering ------------------------------------------------------------

@register("set_union_rows", _w(O.RAW, f"""
SELECT order_id, amount, user_id, NULL AS reject_reason FROM raw WHERE {O.GUARD}
UNION ALL
SELECT order_id, amount, user_id,
       CASE WHEN NOT coalesce(amount > 0 AND amount < 100000, false) THEN 'NULL_OR_BAD_AMOUNT'
            WHEN user_id IS NULL THEN 'NULL_USER' ELSE 'NULL_OR_FUTURE_TIMESTAMP' END
FROM raw WHERE NOT {O.GUARD}"""))
def _union(ctx: OrderContext) -> DataFrame:
    valid = stg_ops.valid_orders(ctx.raw, ctx.as_of).select("order_id", "amount", "user_id")
    rej = ctx.rejected.select("order_id", "amount", "user_id", "reject_reason")
    return valid.unionByName(rej, allowMissingColumns=True)


@register("set_distinct", _w(O.STG, "SELECT DISTINCT user_id FROM stg WHERE is_fraud"))
def _distinct(ctx: OrderContext) -> DataFrame:
    return ctx.staging.filter(F.col("is_fraud")).select("user_id").distinct()


SAMPLE_FRACTION = 0.1
SAMPLE_SEED = 42
_SAMPLE_HEX = format(int(SAMPLE_FRACTION * 16 ** 6), "06x")


@register("smp_seeded", _w(O.STG, f"""
SELECT order_id, order_amount FROM stg
WHERE substr(md5(order_id || '#{SAMPLE_SEED}'), 1, 6) < '{_SAMPLE_HEX}'"""))
def _sample(ctx: OrderContext) -> DataFrame:
    # Hash-based, so the sample is the same on every run and every cluster size.
    h = F.substring(F.md5(F.concat(F.col("order_id"), F.lit(f"#{SAMPLE_SEED}"))), 1, 6)
    return ctx.staging.filter(h < F.lit(_SAMPLE_HEX)).select("order_id", "order_amount")


@register("srt_mart_order", _w(O.DIM_USERS_CTE, "SELECT user_id, total_spend_usd FROM dim_users ORDER BY total_spend_usd DESC"))
def _sorted(ctx: OrderContext) -> DataFrame:
    return marts.dim_users(ctx.staging, ctx.as_of, cols=("user_id", "total_spend_usd")) \
                .orderBy(F.col("total_spend_usd").desc(), F.col("user_id"))


# -- windows ------------------------------------------------------------------------------

@register("win_dedup_latest", _w(P + """, d AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY timestamp DESC, orders_per_user_1m DESC, fraud_score DESC) AS rn
  FROM processed)""", "SELECT order_id, timestamp, orders_per_user_1m, fraud_score FROM d WHERE rn = 1"))
def _dedup(ctx: OrderContext) -> DataFrame:
    return stg_ops.dedup_latest(ctx.processed.select("order_id", "timestamp", "orders_per_user_1m", "fraud_score"),
                                "order_id", ["timestamp", "orders_per_user_1m", "fraud_score"])


for _key, _cols in (("win_rolling_7d", "fraud_rate_pct, fraud_rate_7d_avg"),
                    ("win_dod_change", "fraud_orders_dod_change, total_orders_dod_change"),
                    ("win_wow_change", "fraud_rate_wow_change")):
    def _mk(cols=_cols):
        names = [c.strip() for c in cols.split(",")]

        def fn(ctx: OrderContext) -> DataFrame:
            return marts.fraud_daily(ctx.staging, ctx.as_of).select("order_date", *names)
        return fn
    register(_key, O.FRAUD_DAILY.replace(
        "SELECT order_date, total_orders, unique_users,", f"SELECT order_date, {_cols} FROM (SELECT order_date, total_orders, unique_users,")
        + ") z")(_mk())


@register("win_recent_n", _w(P, """
SELECT order_id, timestamp, amount FROM processed ORDER BY timestamp DESC, order_id DESC LIMIT 50"""))
def _recent_n(ctx: OrderContext) -> DataFrame:
    return ctx.processed.select("order_id", "timestamp", "amount") \
              .orderBy(F.col("timestamp").desc(), F.col("order_id").desc()).limit(50)


# -- velocity joins and aggregates ----------------------------------------------------------

SLIDE_SQL = P + """, pw AS (
  SELECT order_id, user_id, timestamp, floor(epoch_us(timestamp) / 30000000) AS sl FROM processed
), wins AS (
  SELECT user_id, ws, count(*) AS n FROM (
    SELECT user_id, sl AS ws FROM pw UNION ALL SELECT user_id, sl - 1 AS ws FROM pw) t GROUP BY user_id, ws
)"""


@register("agg_user_velocity", _w(SLIDE_SQL, """
SELECT make_timestamp(CAST(ws * 30000000 AS BIGINT)) AS window_start,
       make_timestamp(CAST(ws * 30000000 + 60000000 AS BIGINT)) AS window_end,
       user_id, CAST(n AS INT) AS orders_per_user_1m FROM wins"""))
def _user_velocity(ctx: OrderContext) -> DataFrame:
    return sliding_window_counts(ctx.processed, "user_id", "timestamp")


@register("jn_velocity_range", _w(SLIDE_SQL, """
SELECT pw.order_id, pw.timestamp, CAST(coalesce(max(w.n), 0) AS INT) AS orders_per_user_1m
FROM pw LEFT JOIN wins w ON w.user_id = pw.user_id AND w.ws IN (pw.sl, pw.sl - 1)
GROUP BY pw.order_id, pw.timestamp, pw.user_id"""))
def _vel_range(ctx: OrderContext) -> DataFrame:
    return attach_sliding_velocity(ctx.processed.select("order_id", "user_id", "timestamp")) \
        .select("order_id", "timestamp", "orders_per_user_1m")


# Values live for an hour of event time: an order's until an hour after it, a user's counter over its live orders.
@register("stream_ttl_features", _w(STREAM_CTE + """, live AS (
  SELECT * FROM st WHERE epoch_us(timestamp) + 3600000000 > (SELECT max(epoch_us(timestamp)) FROM judged WHERE reject_reason IS NULL)
)""", """
SELECT 'order:' || order_id AS key, 'velocity_1m' AS feature, CAST(orders_per_user_1m AS DOUBLE) AS value, timestamp + INTERVAL '1' HOUR AS expires_at FROM live
UNION ALL SELECT 'order:' || order_id, 'fraud_score', fraud_score, timestamp + INTERVAL '1' HOUR FROM live
UNION ALL SELECT 'user:' || user_id, 'velocity_1h', CAST(count(*) AS DOUBLE), max(timestamp) + INTERVAL '1' HOUR FROM live GROUP BY user_id"""))
def _ttl(ctx: OrderContext) -> DataFrame:
    live = stream_outputs(ctx, "ttl").live_features(ctx.spark)
    named = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in ("velocity_1m", "fraud_score")])
    orders = live.select(F.concat(F.lit("order:"), "order_id").alias("key"), F.inline(named), "expires_at").select("key", "feature", "value", "expires_at")
    users = live.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("value"), F.max("expires_at").alias("expires_at"))
    return orders.unionByName(users.select(F.concat(F.lit("user:"), "user_id").alias("key"), F.lit("velocity_1h").alias("feature"), "value", "expires_at"))


@register("stream_minute_rollup", _w(STREAM_CTE, """
SELECT order_date, date_trunc('minute', timestamp) AS minute, category, count(*) AS orders,
       CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) AS revenue_cents, CAST(sum(CAST(fraud_score > 0.5 AS INT)) AS BIGINT) AS fraud_orders,
       CAST(sum(CASE WHEN fraud_score > 0.5 THEN CAST(round(amount * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS fraud_revenue_cents,
       CAST(sum(CAST(fraud_score > 0.8 AS INT)) AS BIGINT) AS critical_orders
FROM st GROUP BY 1, 2, 3"""))
def _rollup(ctx: OrderContext) -> DataFrame:
    sums = stream_outputs(ctx, "rollup").minute_sums(ctx.spark)
    return sums.withColumnsRenamed({"revenue": "revenue_cents", "fraud_revenue": "fraud_revenue_cents"})


@register("udf_score_struct", _w(P, """
SELECT order_id, coalesce(s > 0.5, false) AS is_fraud, coalesce(s, CAST(0 AS DOUBLE)) AS fraud_score,
       CASE WHEN s > 0.8 THEN 'CRITICAL' WHEN s > 0.4 THEN 'HIGH' ELSE 'LOW' END AS risk_level, reasoning FROM (
  SELECT order_id, """ + O.REASONING + """ AS reasoning, round(least(CAST(1 AS DOUBLE), CAST(0.05 AS DOUBLE) + CAST(0.25 AS DOUBLE) * location_mismatch
      + CASE WHEN CAST(amount AS DOUBLE) > 1000 THEN CAST(0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      + CASE WHEN hour(timestamp) BETWEEN 0 AND 5 THEN CAST(0.10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      + CAST(0.03 AS DOUBLE) * least(orders_per_user_1m, 10)), 4) AS s FROM processed) t"""))
def _score_struct(ctx: OrderContext) -> DataFrame:
    p = ctx.processed.withColumn("amount", F.col("amount").cast("double"))
    return p.select("order_id", order_stream.score_struct().alias("r")).select(
        "order_id", "r.is_fraud", "r.fraud_score", "r.risk_level", "r.reasoning")


# -- remaining aggregates ---------------------------------------------------------------------

@register("agg_hourly_category", _w(O.STG, """
SELECT date_trunc('hour', order_timestamp) AS hour_bucket, category, count(*) AS actual_orders,
       CAST(SUM(order_amount) AS DECIMAL(18,2)) AS actual_revenue_usd FROM stg GROUP BY 1, 2"""))
def _hourly_cat(ctx: OrderContext) -> DataFrame:
    return ctx.staging.groupBy(F.date_trunc("hour", "order_timestamp").alias("hour_bucket"), "category").agg(
        F.count(F.lit(1)).alias("actual_orders"),
        F.sum("order_amount").cast("decimal(18,2)").alias("actual_revenue_usd"))


@register("agg_distinct_users", _w(O.STG, "SELECT count(DISTINCT user_id) AS unique_users FROM stg"))
def _distinct_users(ctx: OrderContext) -> DataFrame:
    return ctx.staging.agg(F.countDistinct("user_id").alias("unique_users"))


@register("agg_median", _w(O.STG, f"SELECT category, {O.median('order_amount')} AS median_order_value_usd FROM stg GROUP BY category"))
def _median(ctx: OrderContext) -> DataFrame:
    return group_median(ctx.staging, ["category"], "order_amount", "median_order_value_usd")


@register("agg_mode", _w(O.STG + ", " + O.mode_smallest("device_type", "category", "stg", "m")
                         + ", " + O.mode_smallest("CASE WHEN is_fraud THEN device_type END", "category", "stg", "mf")
                         + ", cats AS (SELECT DISTINCT category FROM stg)", """
SELECT c.category, m.m_v AS top_device, mf.mf_v AS top_fraud_device
FROM cats c LEFT JOIN m USING (category) LEFT JOIN mf USING (category)"""))
def _mode(ctx: OrderContext) -> DataFrame:
    return ctx.staging.groupBy("category").agg(
        mode_smallest("device_type").alias("top_device"),
        mode_smallest(F.when(F.col("is_fraud"), F.col("device_type"))).alias("top_fraud_device"))


@register("agg_conditional", _w(O.STG, f"""
SELECT order_date, {O.sum_if('is_fraud', 'order_amount')} AS fraud_revenue_usd,
       {O.rnd(f"SUM(CASE WHEN is_fraud THEN {O.units('fraud_score', 4)} END)", f"SUM(CASE WHEN is_fraud THEN 1 END) * 10000", 4)} AS avg_fraud_score_on_positives,
       {O.cnt_if('is_high_value AND is_fraud')} AS high_value_fraud_count FROM stg GROUP BY order_date"""))
def _conditional(ctx: OrderContext) -> DataFrame:
    from orderflow.functions.exact import scaled_int
    from orderflow.operators.aggregates import sum_if
    g = ctx.staging.groupBy("order_date").agg(
        sum_if(F.col("is_fraud"), "order_amount").alias("fraud_revenue_usd"),
        F.sum(F.when(F.col("is_fraud"), scaled_int("fraud_score", 4))).alias("__u"),
        F.sum(F.when(F.col("is_fraud"), 1)).alias("__n"),
        count_if(F.col("is_high_value") & F.col("is_fraud")).alias("high_value_fraud_count"))
    return g.select("order_date", "fraud_revenue_usd",
                    ratio_round("__u", F.col("__n") * 10000, 4, 10).alias("avg_fraud_score_on_positives"),
                    "high_value_fraud_count")


@register("agg_fraud_daily", _w(O.FRAUD_DAILY_CTE, """
SELECT order_date, total_orders, unique_users, total_revenue_usd, fraud_orders, critical_orders, high_risk_orders,
       fraud_revenue_at_risk_usd, fraud_rate_pct, avg_fraud_score, avg_fraud_score_on_positives,
       location_mismatch_count, late_night_fraud_count, high_value_fraud_count, top_fraud_category FROM daily2"""))
def _daily_base(ctx: OrderContext) -> DataFrame:
    return marts.fraud_daily(ctx.staging, ctx.as_of).select(
        "order_date", "total_orders", "unique_users", "total_revenue_usd", "fraud_orders", "critical_orders",
        "high_risk_orders", "fraud_revenue_at_risk_usd", "fraud_rate_pct", "avg_fraud_score",
        "avg_fraud_score_on_positives", "location_mismatch_count", "late_night_fraud_count",
        "high_value_fraud_count", "top_fraud_category")


PRODUCT_MEASURES = ("product_name", "category", "total_orders", "unique_buyers", "total_revenue_usd",
                    "avg_order_value_usd", "min_order_value_usd", "max_order_value_usd", "median_order_value_usd",
                    "fraud_order_count", "fraud_rate_pct", "total_fraud_exposure_usd", "first_order_at",
                    "last_order_at", "avg_velocity_per_user", "late_night_order_count", "high_value_order_count")


@register("agg_product_dim", _w(O.DIM_PRODUCTS_CTE, f"SELECT {', '.join(PRODUCT_MEASURES)} FROM dim_products"))
def _product_dim(ctx: OrderContext) -> DataFrame:
    return marts.dim_products(ctx.staging, ctx.as_of, PRODUCT_MEASURES)


USER_MEASURES = ("user_id", "total_orders", "first_order_at", "last_order_at", "days_as_customer", "total_spend_usd",
                 "avg_order_value_usd", "max_single_order_usd", "median_order_value_usd", "fraud_order_count",
                 "fraud_rate_pct", "avg_fraud_score", "max_fraud_score", "location_mismatch_count",
                 "late_night_order_count", "high_value_order_count", "avg_velocity", "peak_velocity",
                 "preferred_device", "preferred_category", "orders_last_30d", "spend_last_30d_usd")


@register("agg_user_dim", _w(O.DIM_USERS_CTE, f"SELECT {', '.join(USER_MEASURES)} FROM dim_users"))
def _user_dim(ctx: OrderContext) -> DataFrame:
    return marts.dim_users(ctx.staging, ctx.as_of, cols=USER_MEASURES)


STAR_CTE = (O.FACT_ORDERS_CTE
            + ", " + O.DIM_USERS_CTE[O.DIM_USERS_CTE.index("ustats AS ("):]
            + ", " + O.DIM_PRODUCTS_CTE[O.DIM_PRODUCTS_CTE.index("pstats AS ("):]
            + ", " + O.DIM_TIME_CTE[O.DIM_TIME_CTE.index("tb AS ("):])


@register("jn_star_fact", _w(STAR_CTE, """
SELECT f.order_id, f.user_id, f.time_id, u.user_segment, u.customer_value_tier, p.product_risk_tier,
       t.day_name, t.is_business_hours
FROM fact f LEFT JOIN dim_users u USING (user_id)
LEFT JOIN dim_products p ON p.product_name = f.product_name AND p.category = f.category
LEFT JOIN dim_time t USING (time_id)"""))
def _star(ctx: OrderContext) -> DataFrame:
    stg_plus = stg_ops.staging_orders(ctx.processed, extra=("product_id", "quantity", "payment_method"))
    fact = marts.fact_orders(stg_plus)
    j = marts.star_join(fact, marts.dim_users(ctx.staging, ctx.as_of, cols=("user_id", "user_segment", "customer_value_tier")),
                        marts.dim_products(ctx.staging, ctx.as_of, ("product_name", "category", "product_risk_tier")),
                        marts.dim_time(ctx.staging))
    return j.select("order_id", "user_id", "time_id", "user_segment", "customer_value_tier", "product_risk_tier",
                    "day_name", "is_business_hours")


# -- feedback and case counts ---------------------------------------------------------------

@register("agg_feedback_count", _w(FEEDBACK_CTE, f"""
SELECT count(*) AS total_feedback_entries, {O.cnt_if('model_prediction <> actual_label')} AS corrections,
       {O.rnd(O.cnt_if('model_prediction <> actual_label') + ' * 100', 'count(*)', 2)} AS correction_rate_pct
FROM feedback"""))
def _feedback(ctx: OrderContext) -> DataFrame:
    fb = feedback_rows(ctx)
    g = fb.agg(F.count(F.lit(1)).alias("total_feedback_entries"),
               count_if(F.col("model_prediction") != F.col("actual_label")).alias("corrections"))
    return g.withColumn("correction_rate_pct",
                        ratio_round(F.col("corrections") * 100, "total_feedback_entries", 2, 10))


@register("agg_case_count", _w(AGENT_CTE, """
SELECT count(*) AS cases, count(DISTINCT order_id) AS distinct_orders FROM agent WHERE triage = 'INVESTIGATE'"""))
def _cases(ctx: OrderContext) -> DataFrame:
    inv = agent.investigate(agent.agent_inputs(ctx.processed)).filter(F.col("triage") == "INVESTIGATE")
    return inv.agg(F.count(F.lit(1)).alias("cases"), F.countDistinct("order_id").alias("distinct_orders"))

