"""Registered demand-forecast queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.operators import forecast as fc
from orderflow.plans import oracle as O
from orderflow.plans.context import OrderContext
from orderflow.plans.catalog_base import register

xr = O.xr
from orderflow.session import cut_lineage
from orderflow.sources import sinks, stored

NOW = "(SELECT as_of FROM clock)"
BACKTEST_HOURS = 12


def _w(ctes: str, select: str) -> str:
    return O.with_ctes(ctes, select)


def det3(a, b, c, d, e, f, g, h, i) -> str:
    return f"(({a}) * (({e}) * ({i}) - ({f}) * ({h})) - ({b}) * (({d}) * ({i}) - ({f}) * ({g})) + ({c}) * (({d}) * ({h}) - ({e}) * ({g})))"


W_OF = "(CASE WHEN dayofweek({t}) IN (0, 6) THEN 1 ELSE 0 END)"

FIT_CTE = O.STG + f""", tb AS (
  SELECT date_trunc('hour', MIN(order_timestamp)) AS lo, date_trunc('hour', MAX(order_timestamp)) AS hi FROM stg
), spine AS (
  SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS t FROM tb
), xs AS (
  SELECT CAST(count(*) AS HUGEINT) AS n, CAST(sum(hour(t)) AS HUGEINT) AS sh,
         CAST(sum({W_OF.format(t='t')}) AS HUGEINT) AS sw, CAST(sum(hour(t) * hour(t)) AS HUGEINT) AS shh,
         CAST(sum(hour(t) * {W_OF.format(t='t')}) AS HUGEINT) AS shw,
         CAST(sum({W_OF.format(t='t')} * {W_OF.format(t='t')}) AS HUGEINT) AS sww FROM spine
), act AS (
  SELECT date_trunc('hour', order_timestamp) AS hour_bucket, category, count(*) AS actual_orders,
         CAST(SUM(order_amount) AS DECIMAL(18,2)) AS actual_revenue_usd FROM stg GROUP BY 1, 2
), ys AS (
  SELECT category, CAST(sum(actual_orders) AS HUGEINT) AS sy,
         CAST(sum(actual_orders * hour(hour_bucket)) AS HUGEINT) AS shy,
         CAST(sum(actual_orders * {W_OF.format(t='hour_bucket')}) AS HUGEINT) AS swy FROM act GROUP BY category
), fit AS (
  SELECT category,
         {det3('n', 'sh', 'sw', 'sh', 'shh', 'shw', 'sw', 'shw', 'sww')} AS det,
         {det3('sy', 'sh', 'sw', 'shy', 'shh', 'shw', 'swy', 'shw', 'sww')} AS d0,
         {det3('n', 'sy', 'sw', 'sh', 'shy', 'shw', 'sw', 'swy', 'sww')} AS d1,
         {det3('n', 'sh', 'sy', 'sh', 'shh', 'shy', 'sw', 'shw', 'swy')} AS d2
  FROM ys, xs
)"""


def horizon_sql(origin: str, name: str) -> str:
    num = f"(d0 + d1 * hour(forecast_time) + d2 * {W_OF.format(t='forecast_time')})"
    return f"""{name}_t AS (
  SELECT fit.*, {origin} + INTERVAL 0 HOUR AS generated_at,
         date_trunc('hour', {origin}) + k * INTERVAL 1 HOUR AS forecast_time
  FROM fit, (SELECT unnest(range(1, 25)) AS k) ks
), {name} AS (
  SELECT forecast_time, category,
         CASE WHEN {num} * (CASE WHEN det < 0 THEN -1 ELSE 1 END) < 0 THEN CAST(0 AS DECIMAL(12,2))
              ELSE {xr(num, 'det', 2, 12)} END AS predicted_orders,
         {xr(num + ' * 115', 'det * 100', 2, 12)} AS confidence_upper,
         {xr(num + ' * 85', 'det * 100', 2, 12)} AS confidence_lower,
         '{fc.MODEL_VERSION}' AS model_version, generated_at
  FROM {name}_t
)"""


FORECAST_CTE = FIT_CTE + ", " + horizon_sql(f"{NOW} - INTERVAL {BACKTEST_HOURS} HOUR", "run1") + ", " \
    + horizon_sql(NOW, "run2") + """, demand_forecast AS (
  SELECT forecast_time, category, predicted_orders, confidence_upper, confidence_lower, model_version, generated_at
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY forecast_time, category ORDER BY generated_at DESC) AS rn
        FROM (SELECT * FROM run1 UNION ALL SELECT * FROM run2) u) r WHERE rn = 1
), fva AS (
  SELECT coalesce(a.hour_bucket, f.forecast_time) AS hour_bucket, coalesce(a.category, f.category) AS category,
         coalesce(a.actual_orders, 0) AS actual_orders,
         coalesce(a.actual_revenue_usd, CAST(0 AS DECIMAL(18,2))) AS actual_revenue_usd,
         f.predicted_orders, f.confidence_upper, f.confidence_lower,
         {ae} AS absolute_error,
         CASE WHEN coalesce(a.actual_orders, 0) > 0 THEN {ape} END AS absolute_pct_error,
         coalesce(a.actual_orders BETWEEN f.confidence_lower AND f.confidence_upper, false) AS within_confidence_interval
  FROM act a FULL OUTER JOIN demand_forecast f ON a.hour_bucket = f.forecast_time AND a.category = f.category
)""".format(
        ae=O.rnd("abs(coalesce(a.actual_orders, 0) * 100 - CAST(coalesce(f.predicted_orders, 0) * 100 AS BIGINT))",
                 "100", 2, 14),
        ape=O.rnd("abs(coalesce(a.actual_orders, 0) * 100 - CAST(coalesce(f.predicted_orders, 0) * 100 AS BIGINT))",
                  "coalesce(a.actual_orders, 0)", 4, 14))


def demand_forecast(ctx: OrderContext, actuals: DataFrame | None = None) -> DataFrame:
    fit = fc.fit_seasonal(ctx.staging, actuals)
    origin1 = ctx.as_of - F.make_dt_interval(hours=F.lit(BACKTEST_HOURS))
    run1 = fc.horizon(fit, origin1, origin1)
    run2 = fc.horizon(fit, ctx.as_of, ctx.as_of)
    return sinks.upsert_latest(run1, run2, ["forecast_time", "category"], "generated_at")


def fva_frame(ctx: OrderContext) -> DataFrame:
    act = fc.hourly_actuals(ctx.staging)
    return fc.forecast_vs_actuals(act, demand_forecast(ctx, act))


@register("ml_seasonal_forecast", _w(FIT_CTE, f"""
SELECT category, {xr('d0', 'det', 6)} AS intercept, {xr('d1', 'det', 6)} AS hour_coef,
       {xr('d2', 'det', 6)} AS weekend_coef FROM fit"""))
def _fit(ctx: OrderContext) -> DataFrame:
    return fc.coefficients(fc.fit_seasonal(ctx.staging))


@register("ts_forecast_horizon", _w(FIT_CTE + ", " + horizon_sql(NOW, "run2"), "SELECT * FROM run2"))
def _horizon(ctx: OrderContext) -> DataFrame:
    return fc.horizon(fc.fit_seasonal(ctx.staging), ctx.as_of, ctx.as_of)


@register("snk_upsert_forecast", _w(FORECAST_CTE, "SELECT * FROM demand_forecast"))
def _upsert(ctx: OrderContext) -> DataFrame:
    # Two daily runs into the stored table: the second rewrites the days that it forecasts.
    fit = fc.fit_seasonal(ctx.staging)
    path = sinks.shared_path(ctx.spark, "runs", f"forecast-{uuid.uuid4().hex[:12]}")
    table = stored.StoredTable(path, ("forecast_time", "category"), "generated_at", "forecast_date")
    for origin in (ctx.as_of - F.make_dt_interval(hours=F.lit(BACKTEST_HOURS)), ctx.as_of):
        run = fc.horizon(fit, origin, origin)
        table.merge(cut_lineage(run.withColumn("forecast_date", F.to_date("forecast_time"))))
    rows = table.read(ctx.spark)
    if rows is None:
        return demand_forecast(ctx)
    return rows.select("forecast_time", "category", "predicted_orders", "confidence_upper", "confidence_lower", "model_version", "generated_at")


@register("mart_forecast_vs_actuals", _w(FORECAST_CTE, f"SELECT *, {NOW} AS dbt_updated_at FROM fva"))
def _mart_fva(ctx: OrderContext) -> DataFrame:
    return fva_frame(ctx).withColumn("dbt_updated_at", ctx.as_of)


@register("jn_forecast_actuals", _w(FORECAST_CTE, """
SELECT hour_bucket, category, actual_orders, predicted_orders FROM fva"""))
def _jn_fva(ctx: OrderContext) -> DataFrame:
    return fva_frame(ctx).select("hour_bucket", "category", "actual_orders", "predicted_orders")


@register("agg_forecast_accuracy", _w(FORECAST_CTE, f"""
SELECT count(*) AS rows,
       {O.rnd('SUM(CAST(absolute_error * 100 AS BIGINT))', 'count(*) * 100', 4, 14)} AS mae,
       {O.rnd('SUM(CAST(absolute_pct_error * 10000 AS BIGINT))', 'count(absolute_pct_error) * 10000', 4, 14)} AS mape,
       {O.rnd(O.cnt_if('within_confidence_interval') + ' * 100', 'count(*)', 2)} AS within_band_pct
FROM fva"""))
def _accuracy(ctx: OrderContext) -> DataFrame:
    return fc.accuracy(fva_frame(ctx))


@register("agg_forecast_series", _w(FORECAST_CTE, f"""
SELECT forecast_time, category, predicted_orders FROM demand_forecast WHERE forecast_time > {NOW} - INTERVAL 24 HOUR"""))
def _series(ctx: OrderContext) -> DataFrame:
    return demand_forecast(ctx).filter(F.col("forecast_time") > ctx.as_of - F.expr("INTERVAL 24 HOURS")) \
        .select("forecast_time", "category", "predicted_orders")


@register("jn_forecast_actuals_hour", _w(FORECAST_CTE, f"""
SELECT coalesce(f.forecast_time, a.hr) AS time, a.actual_volume, f.predicted_orders FROM
  (SELECT forecast_time, CAST(SUM(predicted_orders) AS DECIMAL(18,2)) AS predicted_orders FROM demand_forecast
   WHERE forecast_time > {NOW} - INTERVAL 6 HOUR AND forecast_time < {NOW} + INTERVAL 6 HOUR GROUP BY 1) f
FULL OUTER JOIN
  (SELECT date_trunc('hour', timestamp) AS hr, count(*) AS actual_volume FROM processed
   WHERE timestamp > {NOW} - INTERVAL 6 HOUR GROUP BY 1) a
ON f.forecast_time = a.hr"""))
def _fva_hour(ctx: OrderContext) -> DataFrame:
    six = F.expr("INTERVAL 6 HOURS")
    f = (demand_forecast(ctx)
         .filter((F.col("forecast_time") > ctx.as_of - six) & (F.col("forecast_time") < ctx.as_of + six))
         .groupBy("forecast_time").agg(F.sum("predicted_orders").cast("decimal(18,2)").alias("predicted_orders")))
    a = (ctx.processed.filter(F.col("timestamp") > ctx.as_of - six)
         .groupBy(F.date_trunc("hour", "timestamp").alias("hr")).agg(F.count(F.lit(1)).alias("actual_volume")))
    j = f.join(a, f.forecast_time == a.hr, "full_outer")
    return j.select(F.coalesce("forecast_time", "hr").alias("time"), "actual_volume", "predicted_orders")


PANEL_CTE = """o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_custkey FROM orders
), counts AS (
  SELECT c.c_mktsegment AS grp, o.date, count(*) AS volume FROM o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1, 2
), bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM o
), spine AS (
  SELECT g.grp, CAST(unnest(generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT grp FROM counts) g, bounds b
), panel AS (
  SELECT s.grp AS "group", s.date, CAST(date_diff('day', (SELECT lo FROM bounds), s.date) AS INT) AS time_idx,
         CAST(coalesce(c.volume, 0) AS BIGINT) AS volume,
         CASE WHEN dayofweek(s.date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend
  FROM spine s LEFT JOIN counts c ON c.grp = s.grp AND c.date = s.date
)"""


@register("ts_daily_series", _w(PANEL_CTE, "SELECT * FROM panel"))
def _panel(ctx: OrderContext) -> DataFrame:
    return fc.daily_panel(ctx.table("orders"), ctx.table("customer"))


@register("ts_training_windows", _w(PANEL_CTE + """, cut AS (SELECT max(time_idx) - 30 AS c FROM panel
), origins AS (SELECT "group", time_idx AS origin FROM panel WHERE time_idx >= 45 AND time_idx <= (SELECT c FROM cut)
)""", """
SELECT o."group", o.origin,
       CAST(SUM(CASE WHEN p.time_idx < o.origin THEN 1 ELSE 0 END) AS INT) AS encoder_length,
       CAST(SUM(CASE WHEN p.time_idx >= o.origin THEN 1 ELSE 0 END) AS INT) AS decoder_length,
       CAST(SUM(CASE WHEN p.time_idx < o.origin THEN p.volume ELSE 0 END) AS BIGINT) AS encoder_volume,
       CAST(SUM(CASE WHEN p.time_idx >= o.origin THEN p.volume ELSE 0 END) AS BIGINT) AS decoder_volume,
       list(p.volume ORDER BY p.time_idx) FILTER (WHERE p.time_idx < o.origin) AS encoder_volumes,
       list(p.volume ORDER BY p.time_idx) FILTER (WHERE p.time_idx >= o.origin) AS decoder_volumes,
       min(p.time_idx) AS first_idx, max(p.time_idx) AS last_idx
FROM origins o JOIN panel p ON p."group" = o."group"
     AND p.time_idx BETWEEN o.origin - 90 AND o.origin + 29 AND p.time_idx <= (SELECT c FROM cut)
GROUP BY o."group", o.origin"""))
def _windows(ctx: OrderContext) -> DataFrame:
    return fc.training_windows(fc.daily_panel(ctx.table("orders"), ctx.table("customer")))
