"""Demand series, a seasonal least-squares forecast, and forecast accuracy.

The hourly model is ``y = b0 + b1 * hour + b2 * is_weekend``, fitted per
category by the normal equations. Every sum is an integer, so the 3x3 system
is solved exactly by Cramer's rule in DECIMAL(38,0). A prediction is the
exact ratio ``(d0 + d1*h + d2*w) / det``, rounded once. The hour spine is the
same for every category, so its sums come from one generated spine and the
per-category sums from the sparse actual counts. Zero hours add nothing to
the y-sums, and no category x hour cross product is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from orderflow.functions.exact import BIG, exact_ratio_round, ratio_round
from orderflow.functions.scalars import one_row
from orderflow.functions.timeparts import dow_sunday0
from orderflow.session import cut_lineage

HORIZON_HOURS = 24
BAND_UPPER = 115   # percent of the prediction
BAND_LOWER = 85
MODEL_VERSION = "seasonal-ls-v1"
ENCODER_MAX, ENCODER_MIN, HORIZON_MAX, CUTOFF_BACK = 90, 45, 30, 30


def _big(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast(BIG)


def hourly_actuals(stg: DataFrame) -> DataFrame:
    """(hour, category) counts and revenue; checkpointed, as the fit, the spine
    and the comparison all read it (one row per category-hour)."""
    return cut_lineage(stg.groupBy(F.date_trunc("hour", "order_timestamp").alias("hour_bucket"), "category").agg(
        F.count(F.lit(1)).alias("actual_orders"),
        F.sum("order_amount").cast(DecimalType(18, 2)).alias("actual_revenue_usd")))


def spine_sums(actuals: DataFrame) -> dict[str, Column]:
    """Sums of the design over every hour of the span (one scalar struct)."""
    bounds = actuals.agg(F.min("hour_bucket").alias("lo"), F.max("hour_bucket").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("t"))
    h = F.hour("t").cast("long")
    w = dow_sunday0("t").isin(0, 6).cast("long")
    r = one_row(spine.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("sh"), F.sum(w).alias("sw"),
                          F.sum(h * h).alias("shh"), F.sum(h * w).alias("shw"), F.sum(w * w).alias("sww")))
    return {k: F.lit(int(r[k] or 0)).cast(BIG) for k in ("n", "sh", "sw", "shh", "shw", "sww")}


def fit_seasonal(stg: DataFrame, actuals: DataFrame | None = None) -> DataFrame:
    """Per category: determinant terms of the normal equations (exact integers)."""
    act = actuals if actuals is not None else hourly_actuals(stg)
    x = spine_sums(act)
    h = F.hour("hour_bucket").cast("long")
    w = dow_sunday0("hour_bucket").isin(0, 6).cast("long")
    y = F.col("actual_orders")
    ys = act.groupBy("category").agg(F.sum(y).alias("sy"), F.sum(y * h).alias("shy"), F.sum(y * w).alias("swy"))
    n, sh, sw = x["n"], x["sh"], x["sw"]
    shh, shw, sww = x["shh"], x["shw"], x["sww"]
    sy, shy, swy = _big("sy"), _big("shy"), _big("swy")

    def det3(a, b, c, d, e, f, g, hh, i):
        return a * (e * i - f * hh) - b * (d * i - f * g) + c * (d * hh - e * g)

    det = det3(n, sh, sw, sh, shh, shw, sw, shw, sww)
    d0 = det3(sy, sh, sw, shy, shh, shw, swy, shw, sww)
    d1 = det3(n, sy, sw, sh, shy, shw, sw, swy, sww)
    d2 = det3(n, sh, sy, sh, shh, shy, sw, shw, swy)
    return ys.select("category", det.cast(BIG).alias("det"), d0.cast(BIG).alias("d0"),
                     d1.cast(BIG).alias("d1"), d2.cast(BIG).alias("d2"))


def coefficients(fit: DataFrame) -> DataFrame:
    return fit.select("category", *[exact_ratio_round(F.col(d), F.col("det"), 6).alias(b)
                                    for d, b in (("d0", "intercept"), ("d1", "hour_coef"), ("d2", "weekend_coef"))])


def horizon(fit: DataFrame, origin: Column, generated_at: Column, hours: int = HORIZON_HOURS) -> DataFrame:
    """Next ``hours`` hourly predictions per category after ``origin``'s hour,
    floored at 0, with the ±15 % band (computed from the unfloored value)."""
    rows = fit.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(hours))))
    t = F.date_trunc("hour", origin) + F.make_dt_interval(hours=F.col("k"))
    rows = rows.withColumn("forecast_time", t)
    h = _big(F.hour("forecast_time"))
    w = _big(dow_sunday0("forecast_time").isin(0, 6).cast("long"))
    num = (F.col("d0") + F.col("d1") * h + F.col("d2") * w).cast(BIG)
    det = F.col("det")
    pred = exact_ratio_round(num, det, 2, 12)
    floored = F.when(num * F.when(det < 0, -1).otherwise(1) < 0, F.lit(0).cast(DecimalType(12, 2))).otherwise(pred)
    return rows.select(
        "forecast_time", "category",
        floored.alias("predicted_orders"),
        exact_ratio_round((num * BAND_UPPER).cast(BIG), (det * 100).cast(BIG), 2, 12).alias("confidence_upper"),
        exact_ratio_round((num * BAND_LOWER).cast(BIG), (det * 100).cast(BIG), 2, 12).alias("confidence_lower"),
        F.lit(MODEL_VERSION).alias("model_version"),
        generated_at.alias("generated_at"),
    )


def forecast_vs_actuals(actuals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """FULL OUTER JOIN on (hour, category) with per-row accuracy terms."""
    f = forecasts.select(F.col("forecast_time").alias("hour_bucket"), "category", "predicted_orders",
                         "confidence_upper", "confidence_lower")
    j = actuals.join(f, ["hour_bucket", "category"], "full_outer")
    a = F.coalesce(F.col("actual_orders"), F.lit(0))
    p_units = (F.coalesce(F.col("predicted_orders"), F.lit(0)) * 100).cast("long")
    err_units = F.abs(a * 100 - p_units)
    return j.select(
        "hour_bucket", "category",
        a.alias("actual_orders"),
        F.coalesce(F.col("actual_revenue_usd"), F.lit(0).cast(DecimalType(18, 2))).alias("actual_revenue_usd"),
        "predicted_orders", "confidence_upper", "confidence_lower",
        ratio_round(err_units, F.lit(100), 2, 14).alias("absolute_error"),
        F.when(a > 0, ratio_round(err_units, a, 4, 14)).alias("absolute_pct_error"),
        F.coalesce(F.col("actual_orders").between(F.col("confidence_lower"), F.col("confidence_upper")),
                   F.lit(False)).alias("within_confidence_interval"),
    )


def accuracy(fva: DataFrame) -> DataFrame:
    """MAE, MAPE (over rows with actuals) and in-band share (percent)."""
    err_units = (F.col("absolute_error") * 100).cast("long")
    pct_units = (F.col("absolute_pct_error") * 10000).cast("long")
    g = fva.agg(F.count(F.lit(1)).alias("rows"), F.sum(err_units).alias("eu"),
                F.sum(pct_units).alias("pu"), F.count("absolute_pct_error").alias("pn"),
                F.sum(F.col("within_confidence_interval").cast("long")).alias("inband"))
    return g.select("rows",
                    ratio_round("eu", F.col("rows") * 100, 4, 14).alias("mae"),
                    ratio_round("pu", F.col("pn") * 10000, 4, 14).alias("mape"),
                    ratio_round(F.col("inband") * 100, "rows", 2, 10).alias("within_band_pct"))


def daily_panel(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Dense (group, day) panel of order counts with time index and weekend flag.

    Groups are market segments. Each group's day spine is generated from its
    own first and last day, so there is no cross product. Missing days get
    volume 0.
    """
    o = orders.select(F.to_date("o_orderdate").alias("date"), "o_custkey")
    c = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("group"))
    counts = o.join(c, "o_custkey").groupBy("group", "date").agg(F.count(F.lit(1)).alias("volume"))
    b = one_row(o.agg(F.min("date").alias("first"), F.max("date").alias("last")))
    first, last = F.lit(b.first), F.lit(b.last)
    spine = (counts.select("group").distinct()
             .select("group", F.explode(F.sequence(first, last)).alias("date")))
    panel = spine.join(counts, ["group", "date"], "left").fillna(0, subset=["volume"])
    return panel.select(
        "group", "date", F.datediff("date", first).alias("time_idx"), F.col("volume").cast("long").alias("volume"),
        dow_sunday0("date").isin(0, 6).cast("int").alias("is_weekend"))


def _ordered(part: Column) -> Column:
    """The part's volumes by day: at most 120 values."""
    days = F.array_sort(F.collect_list(F.when(part, F.struct("time_idx", "volume"))))
    return F.transform(days, lambda d: d["volume"])


def training_windows(panel: DataFrame) -> DataFrame:
    """One sample per (group, origin): encoder up to 90 days (at least 45)
    before the origin, decoder up to 30 days from it, all at or before the
    cut-off (max time index - 30). Built as a bounded range join: each origin
    spans at most 120 day offsets."""
    cutoff = F.lit(one_row(panel.agg(F.max("time_idx").alias("m"))).m - CUTOFF_BACK)
    origins = (panel.select("group", F.col("time_idx").alias("origin"))
               .filter((F.col("origin") >= ENCODER_MIN) & (F.col("origin") <= cutoff)))
    span = origins.select("group", "origin",
                          F.explode(F.sequence(F.col("origin") - ENCODER_MAX,
                                               F.col("origin") + HORIZON_MAX - 1)).alias("time_idx"))
    span = span.filter((F.col("time_idx") >= 0) & (F.col("time_idx") <= cutoff))
    j = span.join(panel.select("group", "time_idx", "volume"), ["group", "time_idx"])
    enc = F.col("time_idx") < F.col("origin")
    return j.groupBy("group", "origin").agg(
        F.sum(enc.cast("int")).cast("int").alias("encoder_length"),
        F.sum((~enc).cast("int")).cast("int").alias("decoder_length"),
        F.sum(F.when(enc, F.col("volume")).otherwise(0)).alias("encoder_volume"),
        F.sum(F.when(~enc, F.col("volume")).otherwise(0)).alias("decoder_volume"),
        _ordered(enc).alias("encoder_volumes"), _ordered(~enc).alias("decoder_volumes"),
        F.min("time_idx").alias("first_idx"), F.max("time_idx").alias("last_idx"))
