"""Registered feature, window, lookup, evaluation and drift queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.functions.exact import mean_fixed, ratio_round
from orderflow.functions.scalars import one_row
from orderflow.operators import agent, drift, evaluation, features, stats
from orderflow.operators import staging as stg_ops
from orderflow.operators.features import FEATURE_COLS, r6
from orderflow.operators.velocity import trailing_count
from orderflow.plans import oracle as O
from orderflow.plans.catalog_ops import AGENT_CTE
from orderflow.plans.context import OrderContext
from orderflow.plans.catalog_base import register
from orderflow.session import cut_lineage


def _w(ctes: str, select: str) -> str:
    return O.with_ctes(ctes, select)


def R6(x: str) -> str:
    return f"CAST(round({x}, 6) AS DECIMAL(20,6))"


def transactions(ctx: OrderContext) -> DataFrame:
    return stg_ops.staging_orders(ctx.processed, extra=("account_age_days", "ip_address", "shipping_address", "checkout_seconds", "payment_method"))


def feature_frame(ctx: OrderContext, *cols: str) -> DataFrame:
    """order_id, split, is_fraud and the features ``cols`` (all, if none is named)."""
    return features.engineer(transactions(ctx), cols or FEATURE_COLS)


STG_FEAT = O.staging("account_age_days, ip_address, shipping_address, checkout_seconds, payment_method")

SPLIT_CTE = STG_FEAT + """, sp AS (
  SELECT *, CASE WHEN ROW_NUMBER() OVER (ORDER BY epoch_us(order_timestamp), order_id) - 1
                      < floor((SELECT count(*) FROM stg) * 80 / 100) THEN 'train' ELSE 'test' END AS split
  FROM stg
), tr AS (SELECT * FROM sp WHERE split = 'train')"""

FEAT_CTE = SPLIT_CTE + """, dev AS (
  SELECT device_type, CAST(ROW_NUMBER() OVER (ORDER BY device_type) - 1 AS INT) AS device_type_enc
  FROM (SELECT DISTINCT CAST(device_type AS VARCHAR) AS device_type FROM tr WHERE device_type IS NOT NULL) d
), us AS (
  SELECT user_id, avg(CAST(order_amount AS DOUBLE)) AS u_mean,
         CASE WHEN coalesce(stddev_samp(CAST(order_amount AS DOUBLE)), 1.0) = 0 THEN 1.0
              ELSE coalesce(stddev_samp(CAST(order_amount AS DOUBLE)), 1.0) END AS u_std
  FROM tr GROUP BY user_id
), gs AS (
  SELECT avg(CAST(order_amount AS DOUBLE)) AS g_mean, coalesce(stddev_samp(CAST(order_amount AS DOUBLE)), 1.0) AS g_std FROM tr
), p95 AS (
  SELECT quantile_cont(CAST(order_amount AS DOUBLE), 0.95) AS v FROM tr
), kfa AS (
  SELECT DISTINCT shipping_address FROM tr WHERE is_fraud
), f0 AS (
  SELECT sp.*, coalesce(dev.device_type_enc, -1) AS dte,
         coalesce((CAST(sp.order_amount AS DOUBLE) - coalesce(us.u_mean, gs.g_mean))
                  / CASE WHEN coalesce(us.u_std, gs.g_std) = 0 THEN 1.0 ELSE coalesce(us.u_std, gs.g_std) END, 0.0) AS z,
         CAST(count(*) OVER (PARTITION BY sp.split, sp.user_id ORDER BY epoch_us(sp.order_timestamp)
              RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS INT) AS vh,
         CAST(2 * (RANK() OVER (PARTITION BY sp.split ORDER BY sp.order_amount) - 1)
              + count(*) OVER (PARTITION BY sp.split, sp.order_amount) + 1 AS DOUBLE)
           / CAST(2 * count(*) OVER (PARTITION BY sp.split) AS DOUBLE) AS pr,
         CASE WHEN kfa.shipping_address IS NOT NULL THEN 1 ELSE 0 END AS kf,
         CASE WHEN CAST(sp.order_amount AS DOUBLE) > (SELECT v FROM p95) THEN 1 ELSE 0 END AS hv
  FROM sp LEFT JOIN dev ON CAST(sp.device_type AS VARCHAR) = dev.device_type
          LEFT JOIN us USING (user_id) LEFT JOIN gs ON true LEFT JOIN kfa USING (shipping_address)
), feat AS (
  SELECT order_id, split, CAST(is_fraud AS INT) AS is_fraud, CAST(order_amount AS DOUBLE) AS order_amount,
         orders_per_user_1m AS orders_per_user_last_minute, CAST(location_mismatch AS INT) AS location_mismatch,
         dte AS device_type_enc, z AS amount_zscore_user, vh AS orders_per_user_last_hour, pr AS amount_pct_rank,
         CAST(account_age_days < 30 AS INT) AS is_new_user, CAST(hour(order_timestamp) AS INT) AS order_hour,
         CASE WHEN hour(order_timestamp) >= 23 OR hour(order_timestamp) <= 4 THEN 1 ELSE 0 END AS is_late_night,
         CAST(checkout_seconds < 10 AS INT) AS fast_checkout, hv AS is_high_value, kf AS known_fraud_address,
         orders_per_user_1m * CAST(order_amount AS DOUBLE) AS velocity_amount_interaction,
         CAST(location_mismatch AS INT) * hv AS location_highvalue_risk
  FROM f0
)"""

DOUBLE_FEATURES = ("order_amount", "amount_zscore_user", "amount_pct_rank", "velocity_amount_interaction")


def feat_select(cols) -> str:
    return ", ".join(R6(c) + f" AS {c}" if c in DOUBLE_FEATURES else c for c in cols)


@register("feat_matrix", _w(FEAT_CTE, f"SELECT order_id, split, is_fraud, {feat_select(FEATURE_COLS)} FROM feat"))
def _feat_matrix(ctx: OrderContext) -> DataFrame:
    return features.rounded(feature_frame(ctx))


@register("win_chrono_split", _w(SPLIT_CTE, "SELECT order_id, split FROM sp"))
def _split(ctx: OrderContext) -> DataFrame:
    return features.chrono_split(transactions(ctx)).select("order_id", "split")


@register("agg_class_balance", _w(SPLIT_CTE, f"""
SELECT split, count(*) AS rows, {O.cnt_if('is_fraud')} AS fraud_rows,
       {O.rnd(O.cnt_if('is_fraud') + ' * 100', 'count(*)', 2)} AS fraud_pct FROM sp GROUP BY split"""))
def _balance(ctx: OrderContext) -> DataFrame:
    sp = features.chrono_split(transactions(ctx))
    g = sp.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                F.sum(F.col("is_fraud").cast("long")).alias("fraud_rows"))
    return g.withColumn("fraud_pct", ratio_round(F.col("fraud_rows") * 100, "rows", 2, 10))


ENCODED = ("device_type", "payment_method", "category")


def _code(col: str) -> str:
    return (f"coalesce((SELECT c FROM (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS c FROM "
            f"(SELECT DISTINCT {col} AS v FROM tr WHERE {col} IS NOT NULL) d) x WHERE x.v = sp.{col}), -1) AS {col}_enc")


@register("feat_label_encode", _w(SPLIT_CTE, f"SELECT order_id, split, {', '.join(map(_code, ENCODED))} FROM sp"))
def _label_encode(ctx: OrderContext) -> DataFrame:
    sp = features.chrono_split(transactions(ctx))
    codes = features.label_dictionary(sp.filter(F.col("split") == "train"), ENCODED)
    return features.label_encode(sp, codes, ENCODED).select("order_id", "split", *[f"{c}_enc" for c in ENCODED])


@register("feat_amount_zscore", _w(FEAT_CTE, f"SELECT order_id, split, {R6('amount_zscore_user')} AS amount_zscore_user FROM feat"))
def _zscore(ctx: OrderContext) -> DataFrame:
    return features.rounded(feature_frame(ctx, "amount_zscore_user").select("order_id", "split", "amount_zscore_user"))


FLAG_COLS = ("is_new_user", "order_hour", "is_late_night", "fast_checkout", "is_high_value")


@register("feat_flags", _w(FEAT_CTE, f"SELECT order_id, {', '.join(FLAG_COLS)} FROM feat"))
def _flags(ctx: OrderContext) -> DataFrame:
    return feature_frame(ctx, *FLAG_COLS).select("order_id", *FLAG_COLS)


@register("feat_interactions", _w(FEAT_CTE, f"""
SELECT order_id, {R6('velocity_amount_interaction')} AS velocity_amount_interaction, location_highvalue_risk FROM feat"""))
def _interactions(ctx: OrderContext) -> DataFrame:
    return features.rounded(feature_frame(ctx, "velocity_amount_interaction", "location_highvalue_risk").drop("split", "is_fraud"))


@register("win_pct_rank", _w(FEAT_CTE, f"""
SELECT order_id, split, {R6('amount_pct_rank')} AS amount_pct_rank,
       {R6('CAST(2 * (SELECT count(*) FROM tr WHERE tr.order_amount < feat.order_amount) + (SELECT count(*) FROM tr WHERE tr.order_amount = feat.order_amount) AS DOUBLE) / CAST(2 * (SELECT count(*) FROM tr) AS DOUBLE)')} AS amount_pct_rank_train
FROM feat"""))
def _pct_rank(ctx: OrderContext) -> DataFrame:
    ranked = features.pct_rank_of_train(feature_frame(ctx, "order_amount", "amount_pct_rank").select("order_id", "split", "order_amount", "amount_pct_rank"))
    return features.rounded(ranked.select("order_id", "split", "amount_pct_rank", "amount_pct_rank_train"))


@register("win_velocity_1h", _w(FEAT_CTE, "SELECT order_id, split, orders_per_user_last_hour FROM feat"))
def _vel_1h(ctx: OrderContext) -> DataFrame:
    return feature_frame(ctx, "orders_per_user_last_hour").select("order_id", "split", "orders_per_user_last_hour")


@register("jn_known_fraud_address", _w(FEAT_CTE, "SELECT order_id, known_fraud_address FROM feat"))
def _kfa(ctx: OrderContext) -> DataFrame:
    return feature_frame(ctx, "known_fraud_address").select("order_id", "known_fraud_address")


@register("jn_user_stats_lookup", _w(FEAT_CTE, f"""
SELECT sp.order_id, coalesce(um.m, gm.m) AS user_mean, {R6('coalesce(us.u_std, gs.g_std)')} AS user_std
FROM sp LEFT JOIN us USING (user_id) LEFT JOIN gs ON true
LEFT JOIN (SELECT user_id, {O.mean6('order_amount')} AS m FROM tr GROUP BY user_id) um USING (user_id)
LEFT JOIN (SELECT {O.mean6('order_amount')} AS m FROM tr) gm ON true"""))
def _user_stats_lookup(ctx: OrderContext) -> DataFrame:
    sp = features.chrono_split(transactions(ctx))
    train = sp.filter(F.col("split") == "train")
    um = train.groupBy("user_id").agg(mean_fixed("order_amount").alias("__um"))
    _, std = features.train_amount_stats(train)
    mean = one_row(train.agg(mean_fixed("order_amount").alias("m"))).m
    j = sp.join(features.user_amount_stats(train), "user_id", "left").join(um, "user_id", "left")
    return j.select("order_id", F.coalesce("__um", F.lit(mean).cast("decimal(20,6)")).alias("user_mean"),
                    r6(F.coalesce("__u_std", F.lit(std).cast("double"))).alias("user_std"))


STANDARD_CTE = FEAT_CTE + f""", fs AS (
  SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}'
                    for c in FEATURE_COLS)}
  FROM feat WHERE split = 'train')"""


@register("feat_standardize", _w(STANDARD_CTE, f"""
SELECT order_id, split, is_fraud, {', '.join(R6(f'(CAST({c} AS DOUBLE) - m_{c}) / s_{c}') + f' AS {c}' for c in FEATURE_COLS)}
FROM feat, fs"""))
def _standardize(ctx: OrderContext) -> DataFrame:
    return features.rounded(features.standardize(feature_frame(ctx)))


@register("jn_profile_enrich", _w(SPLIT_CTE + f""", prof AS (
  SELECT user_id, max(account_age_days) AS account_age_days, avg(CAST(order_amount AS DOUBLE)) AS avg_order_value_usd,
         stddev_samp(CAST(order_amount AS DOUBLE)) AS std_order_value_usd, {O.mean6('order_amount')} AS mean6
  FROM tr GROUP BY user_id)""", f"""
SELECT t.order_id, coalesce(p.account_age_days, 30) AS account_age,
       coalesce(p.mean6, CAST(t.order_amount AS DECIMAL(20,6))) AS user_mean,
       {R6('coalesce(p.std_order_value_usd, 1.0)')} AS user_std,
       t.orders_per_user_1m * 4 AS orders_last_hour,
       {R6('(CAST(t.order_amount AS DOUBLE) - coalesce(p.avg_order_value_usd, CAST(t.order_amount AS DOUBLE))) / coalesce(p.std_order_value_usd, 1.0)')} AS amount_zscore
FROM sp t LEFT JOIN prof p USING (user_id) WHERE t.split = 'test'"""))
def _profile(ctx: OrderContext) -> DataFrame:
    sp = features.chrono_split(transactions(ctx))
    prof = sp.filter(F.col("split") == "train").groupBy("user_id").agg(
        F.max("account_age_days").alias("p_age"),
        F.avg(F.col("order_amount").cast("double")).alias("p_mean"),
        F.stddev_samp(F.col("order_amount").cast("double")).alias("p_std"),
        mean_fixed("order_amount").alias("p_mean6"))
    t = sp.filter(F.col("split") == "test").join(prof, "user_id", "left")
    amount = F.col("order_amount").cast("double")
    mean = F.coalesce("p_mean", amount)
    std = F.coalesce("p_std", F.lit(1.0))
    mean6 = F.coalesce("p_mean6", F.col("order_amount").cast("decimal(20,6)"))
    return t.select("order_id", F.coalesce("p_age", F.lit(30)).alias("account_age"), mean6.alias("user_mean"),
                    r6(std).alias("user_std"), (F.col("orders_per_user_1m") * 4).alias("orders_last_hour"),
                    r6((amount - mean) / std).alias("amount_zscore"))


@register("agg_user_mean_std", _w(O.STG, f"""
SELECT user_id, {O.mean6('order_amount')} AS mean_amount,
       {R6('coalesce(stddev_samp(CAST(order_amount AS DOUBLE)), 1.0)')} AS std_amount FROM stg GROUP BY user_id"""))
def _mean_std(ctx: OrderContext) -> DataFrame:
    s = features.user_amount_stats(ctx.staging)
    m = ctx.staging.groupBy("user_id").agg(mean_fixed("order_amount").alias("mean_amount"))
    return s.join(m, "user_id").select("user_id", "mean_amount", r6(F.col("__u_std")).alias("std_amount"))


@register("win_group_count", _w(O.STG, """
SELECT order_id, user_id, count(*) OVER (PARTITION BY user_id) AS user_order_count,
       count(*) OVER (PARTITION BY user_id) = 1 AS is_first_time_buyer FROM stg"""))
def _group_count(ctx: OrderContext) -> DataFrame:
    s = ctx.staging
    # Grouped count joined back: combinable map-side, unlike a per-user window.
    c = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_order_count"))
    return s.select("order_id", "user_id").join(c, "user_id", "left") \
            .withColumn("is_first_time_buyer", F.col("user_order_count") == 1)


@register("win_velocity_1m", _w(O.PROCESSED, """
SELECT order_id, timestamp, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(timestamp)
       RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS INT) AS velocity_1m FROM processed"""))
def _vel_1m(ctx: OrderContext) -> DataFrame:
    us = ctx.processed.select("order_id", "user_id", "timestamp", F.unix_micros("timestamp").alias("__us"))
    out = trailing_count(us, ["user_id"], "__us", 59_999_999, "velocity_1m")
    return out.select("order_id", "timestamp", F.col("velocity_1m").cast("int").alias("velocity_1m"))


@register("agg_quantiles", _w(O.STG, f"""
SELECT unnest([0.25, 0.5, 0.75, 0.95]) AS q,
       unnest(list_transform(quantile_cont(CAST(order_amount AS DOUBLE), [0.25, 0.5, 0.75, 0.95]),
                             lambda v: {R6('v')})) AS quantile
FROM stg"""))
def _quantiles(ctx: OrderContext) -> DataFrame:
    q = stats.quantiles_exact(ctx.staging, [], "order_amount", [0.25, 0.5, 0.75, 0.95])
    return q.select(F.col("q").cast("decimal(4,2)").alias("q"), r6(F.col("quantile")).alias("quantile"))


DIST_COLS = tuple(FEATURE_COLS) + ("is_fraud",)
LONG_TRAIN_CTE = FEAT_CTE + f""", ftr AS (
  SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in DIST_COLS)} FROM feat WHERE split = 'train'
), lt AS (UNPIVOT ftr ON {', '.join(DIST_COLS)} INTO NAME feature VALUE value)"""


@register("agg_distribution_stats", _w(LONG_TRAIN_CTE, f"""
SELECT feature, {O.mean6('value')} AS mean, {R6('stddev_samp(value)')} AS std, {R6('min(value)')} AS min,
       {R6('max(value)')} AS max, {R6('quantile_cont(value, 0.25)')} AS quantile_25,
       {R6('quantile_cont(value, 0.5)')} AS quantile_50, {R6('quantile_cont(value, 0.75)')} AS quantile_75
FROM lt GROUP BY feature"""))
def _dist_stats(ctx: OrderContext) -> DataFrame:
    # Read by the moments, and twice by the quantiles.
    f = cut_lineage(feature_frame(ctx).filter(F.col("split") == "train"))
    long = stats.unpivot(f, [], DIST_COLS)
    m = long.groupBy("feature").agg(mean_fixed("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                    F.min("value").alias("min"), F.max("value").alias("max"))
    q = stats.quantiles_exact(long, ["feature"], "value", [0.25, 0.5, 0.75])
    qw = q.groupBy("feature").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
    qw = qw.toDF("feature", "quantile_25", "quantile_50", "quantile_75")
    j = m.join(qw, "feature", "left")
    return j.select("feature", "mean", *[r6(F.col(c)).alias(c) for c in
                                         ("std", "min", "max", "quantile_25", "quantile_50", "quantile_75")])


# -- evaluation -----------------------------------------------------------------------

EVAL_CTE = AGENT_CTE + """, ev AS (
  SELECT CAST(ensemble_score > 0.5 OR decision = 'FINAL_BLOCK' AS INT) AS y_true, gnn_score AS y_score, amount FROM agent
), cur AS (
  SELECT y_score, SUM(y_true) AS pos_eq, SUM(1 - y_true) AS neg_eq FROM ev GROUP BY y_score
), cum AS (
  SELECT *, SUM(pos_eq) OVER (ORDER BY y_score DESC ROWS UNBOUNDED PRECEDING) AS tps,
         SUM(neg_eq) OVER (ORDER BY y_score DESC ROWS UNBOUNDED PRECEDING) AS fps,
         SUM(pos_eq) OVER () AS p_tot, SUM(neg_eq) OVER () AS n_tot FROM cur
), grid AS (
  SELECT i AS idx, CASE WHEN i = 999 THEN CAST(0.9999 AS DOUBLE)
         ELSE CAST(i AS DOUBLE) * ((CAST(0.9999 AS DOUBLE) - CAST(0.0001 AS DOUBLE)) / 999.0) + CAST(0.0001 AS DOUBLE) END AS threshold
  FROM range(1000) t(i)
), costs AS (
  SELECT g.idx, g.threshold, CAST(SUM(CASE WHEN e.y_true = 0 AND e.y_score >= g.threshold THEN 80
                                           WHEN e.y_true = 1 AND e.y_score < g.threshold THEN e.amount + 20 ELSE 0 END)
                                  AS DECIMAL(20,2)) AS total_cost
  FROM grid g, ev e GROUP BY g.idx, g.threshold
), best_cost AS (
  SELECT threshold, total_cost FROM costs ORDER BY total_cost, idx LIMIT 1
)"""


def scored_frame(ctx: OrderContext) -> DataFrame:
    inv = agent.investigate(agent.agent_inputs(ctx.processed))
    return cut_lineage(inv.select(F.col("final_is_fraud").cast("int").alias("y_true"),
                                  F.col("gnn_score").alias("y_score"), "amount"))


@register("ml_pr_auc_roc_auc", _w(EVAL_CTE, """
SELECT round(SUM(CAST(pos_eq AS DOUBLE) / CAST(p_tot AS DOUBLE) * (CAST(tps AS DOUBLE) / CAST(tps + fps AS DOUBLE))), 6) AS pr_auc,
       round(CAST(SUM(pos_eq * (2 * (n_tot - fps) + neg_eq)) AS DOUBLE) / CAST(max(p_tot) * max(n_tot) * 2 AS DOUBLE), 6) AS roc_auc,
       CAST(max(p_tot) AS BIGINT) AS n_pos, CAST(max(n_tot) AS BIGINT) AS n_neg FROM cum"""))
def _auc(ctx: OrderContext) -> DataFrame:
    return evaluation.pr_roc_auc(scored_frame(ctx))


@register("ml_threshold_fbeta", _w(EVAL_CTE, """
SELECT y_score AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f_score FROM (
  SELECT y_score, p, r, (1 + 1.0) * (p * r) / (p * 1.0 + r + 1e-8) AS f FROM (
    SELECT y_score, CAST(tps AS DOUBLE) / CAST(tps + fps AS DOUBLE) AS p,
           CASE WHEN p_tot = 0 THEN 1.0 ELSE CAST(tps AS DOUBLE) / CAST(p_tot AS DOUBLE) END AS r FROM cum) a) b
ORDER BY f DESC, y_score ASC LIMIT 1"""))
def _fbeta(ctx: OrderContext) -> DataFrame:
    return evaluation.best_fbeta_threshold(scored_frame(ctx))


@register("ml_threshold_cost", _w(EVAL_CTE, "SELECT threshold, total_cost FROM best_cost"))
def _cost(ctx: OrderContext) -> DataFrame:
    return evaluation.best_cost_threshold(scored_frame(ctx))


@register("ml_confusion", _w(EVAL_CTE, """
SELECT tn, fp, fn, tp,
       round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END, 6) AS f1
FROM (SELECT CAST(SUM(CASE WHEN y_score < t AND y_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(SUM(CASE WHEN y_score >= t AND y_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(SUM(CASE WHEN y_score < t AND y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             CAST(SUM(CASE WHEN y_score >= t AND y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
      FROM ev, (SELECT threshold AS t FROM best_cost) b) c"""))
def _confusion(ctx: OrderContext) -> DataFrame:
    scored = scored_frame(ctx)
    thr = F.lit(one_row(evaluation.best_cost_threshold(scored).select("threshold")).threshold)
    return evaluation.confusion(scored, thr)


# -- drift (reference = train features, current = test features) ----------------------

DRIFT_COLS = DIST_COLS
LONG_CTE = FEAT_CTE + f""", fl AS (
  SELECT split, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in DRIFT_COLS)} FROM feat
), lg0 AS (UNPIVOT fl ON {', '.join(DRIFT_COLS)} INTO NAME feature VALUE value
), lg AS (SELECT feature, value, CASE WHEN split = 'train' THEN 1 ELSE 0 END AS is_ref FROM lg0
), vc AS (
  SELECT feature, value, SUM(is_ref) AS r_eq, SUM(1 - is_ref) AS c_eq FROM lg GROUP BY feature, value
), cdf AS (
  SELECT feature, value,
         SUM(r_eq) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS r_le,
         SUM(c_eq) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS c_le,
         SUM(r_eq) OVER (PARTITION BY feature) AS nr, SUM(c_eq) OVER (PARTITION BY feature) AS nc,
         lead(value) OVER (PARTITION BY feature ORDER BY value) AS nxt FROM vc
), kw AS (
  SELECT feature, CAST(max(nr) AS BIGINT) AS n_ref, CAST(max(nc) AS BIGINT) AS n_cur,
         round(CAST(max(abs(r_le * nc - c_le * nr)) AS DOUBLE) / CAST(max(nr) * max(nc) AS DOUBLE), 6) AS ks_stat,
         round(SUM(CASE WHEN nxt IS NOT NULL THEN (nxt - value)
                   * (CAST(abs(r_le * nc - c_le * nr) AS DOUBLE) / CAST(nr * nc AS DOUBLE)) ELSE 0.0 END), 6) AS wasserstein
  FROM cdf GROUP BY feature
), rsd AS (SELECT feature, stddev_pop(value) AS sd FROM lg WHERE is_ref = 1 GROUP BY feature
), coldrift AS (
  SELECT kw.*, wasserstein / (CASE WHEN rsd.sd > 0 THEN rsd.sd ELSE 1.0 END) > 0.1 AS drifted
  FROM kw LEFT JOIN rsd USING (feature)
), share AS (
  SELECT count(*) AS n_columns, CAST(SUM(CAST(drifted AS INT)) AS BIGINT) AS n_drifted, max(n_cur) AS n_current,
         round(CAST(SUM(CAST(drifted AS INT)) AS DOUBLE) / CAST(count(*) AS DOUBLE), 4) AS drift_share,
         round(CAST(SUM(CAST(drifted AS INT)) AS DOUBLE) / CAST(count(*) AS DOUBLE), 4) >= 0.5 AS dataset_drift
  FROM coldrift
)"""


def long_features(ctx: OrderContext) -> DataFrame:
    return drift.long_split(feature_frame(ctx, *DRIFT_COLS), F.col("split") == "train", DRIFT_COLS)


def kept_long_features(ctx: OrderContext) -> DataFrame:
    """``long_features`` for several passes. What is stored is the frame, a row an order; it is made long anew in each pass."""
    return drift.long_split(cut_lineage(feature_frame(ctx, *DRIFT_COLS)), F.col("split") == "train", DRIFT_COLS)


@register("drift_mean_shift", _w(LONG_CTE, f"""
SELECT *, round(abs(CAST(cur_mean AS DOUBLE) - CAST(ref_mean AS DOUBLE)) / (CAST(ref_mean AS DOUBLE) + 1e-8) * 100, 6)
       AS mean_diff_pct FROM (
SELECT feature, {O.mean6('CASE WHEN is_ref = 1 THEN value END')} AS ref_mean,
       round(stddev_samp(CASE WHEN is_ref = 1 THEN value END), 6) AS ref_std,
       {O.mean6('CASE WHEN is_ref = 0 THEN value END')} AS cur_mean,
       round(stddev_samp(CASE WHEN is_ref = 0 THEN value END), 6) AS cur_std
FROM lg GROUP BY feature) m"""))
def _mean_shift(ctx: OrderContext) -> DataFrame:
    return drift.mean_shift(long_features(ctx))


@register("drift_ks_wasserstein", _w(LONG_CTE, "SELECT feature, n_ref, n_cur, ks_stat, wasserstein, drifted FROM coldrift"))
def _ks(ctx: OrderContext) -> DataFrame:
    return drift.column_drift(kept_long_features(ctx))


@register("drift_share", _w(LONG_CTE, "SELECT n_columns, n_drifted, CAST(n_current AS BIGINT) AS n_current, drift_share, dataset_drift FROM share"))
def _share(ctx: OrderContext) -> DataFrame:
    return drift.drift_share(drift.column_drift(kept_long_features(ctx)))


@register("drift_gate", _w(LONG_CTE, """
SELECT CAST(n_current AS BIGINT) AS n_current, drift_share, CASE WHEN n_current >= 50 THEN drift_share ELSE 0.0 END AS drift_score,
       n_current >= 50 AND dataset_drift AS drift_detected,
       CASE WHEN (CASE WHEN n_current >= 50 THEN drift_share ELSE 0.0 END) > 0.3 OR (n_current >= 50 AND dataset_drift)
            THEN 'RETRAIN' ELSE 'SKIP' END AS decision FROM share"""))
def _gate(ctx: OrderContext) -> DataFrame:
    return drift.gate(drift.drift_share(drift.column_drift(kept_long_features(ctx))))


@register("prj_align_columns", _w(FEAT_CTE, f"""
SELECT {', '.join(R6(c) + f' AS {c}' if c in DOUBLE_FEATURES else c for c in ('order_amount', 'orders_per_user_last_minute', 'is_fraud'))}
FROM feat WHERE split = 'test'"""))
def _align(ctx: OrderContext) -> DataFrame:
    f = feature_frame(ctx, "order_amount", "orders_per_user_last_minute", "amount_pct_rank", "order_hour")
    reference = f.filter(F.col("split") == "train").select("order_amount", "orders_per_user_last_minute", "is_fraud",
                                                           "amount_pct_rank")
    current = f.filter(F.col("split") == "test").select("is_fraud", "orders_per_user_last_minute", "order_amount",
                                                        "order_hour")
    cols = drift.aligned_columns(reference, current)
    return features.rounded(current.select(*cols))
