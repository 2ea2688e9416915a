"""Drift statistics and gate; exact seasonal fit; forecast-vs-actual join."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from orderflow.operators import drift
from orderflow.operators import forecast as fc


def _frames(spark, n_ref, n_cur, shift):
    rng = np.random.default_rng(0)
    ref = [(float(x), int(v)) for x, v in zip(np.round(rng.normal(0, 1, n_ref), 3), rng.integers(0, 3, n_ref))]
    cur = [(float(x + shift), int(v)) for x, v in zip(np.round(rng.normal(0, 1, n_cur), 3), rng.integers(0, 3, n_cur))]
    schema = "a double, b long"
    return spark.createDataFrame(ref, schema), spark.createDataFrame(cur, schema)


def test_identical_frames_do_not_drift(spark):
    ref, _ = _frames(spark, 300, 300, 0.0)
    per = drift.column_drift(drift.long_frame(ref, ref, ["a", "b"]))
    assert all(r.ks_stat == 0.0 and r.wasserstein == 0.0 and not r.drifted for r in per.collect())
    share = drift.drift_share(per).first()
    assert share.drift_share == 0.0 and not share.dataset_drift


def test_shifted_frame_drifts_and_gate(spark):
    ref, cur = _frames(spark, 300, 300, 3.0)
    per = {r.feature: r for r in drift.column_drift(drift.long_frame(ref, cur, ["a", "b"])).collect()}
    assert per["a"].drifted and not per["b"].drifted
    a_ref = np.array([r.a for r in ref.collect()])
    a_cur = np.array([r.a for r in cur.collect()])
    grid = np.sort(np.unique(np.concatenate([a_ref, a_cur])))
    cdf_r = np.searchsorted(np.sort(a_ref), grid, side="right") / a_ref.size
    cdf_c = np.searchsorted(np.sort(a_cur), grid, side="right") / a_cur.size
    assert abs(per["a"].ks_stat - round(np.abs(cdf_r - cdf_c).max(), 6)) < 1e-9
    wd = np.sum(np.diff(grid) * np.abs(cdf_r - cdf_c)[:-1])
    assert abs(per["a"].wasserstein - round(wd, 6)) < 1e-6
    gate = drift.gate(drift.drift_share(drift.column_drift(drift.long_frame(ref, cur, ["a", "b"])))).first()
    assert gate.decision == "RETRAIN"
    small_ref, small_cur = _frames(spark, 300, 49, 3.0)
    g49 = drift.gate(drift.drift_share(drift.column_drift(drift.long_frame(small_ref, small_cur, ["a", "b"])))).first()
    assert g49.decision == "SKIP" and g49.drift_score == 0.0


def test_seasonal_fit_is_exact_least_squares(spark):
    base = dt.datetime(2024, 1, 5)
    rng = np.random.default_rng(2)
    rows = []
    for h in range(24 * 9):
        for _ in range(int(rng.integers(0, 4))):
            rows.append((base + dt.timedelta(hours=h, minutes=5), "c1", Decimal("1.00")))
    stg = spark.createDataFrame(rows, "order_timestamp timestamp, category string, order_amount decimal(12,2)")
    coef = fc.coefficients(fc.fit_seasonal(stg)).first()
    first = min(t for t, _, _ in rows).replace(minute=0)
    last = max(t for t, _, _ in rows).replace(minute=0)
    hours = [first + dt.timedelta(hours=h) for h in range(int((last - first).total_seconds() // 3600) + 1)]
    base = first
    y = np.zeros(len(hours))
    for t, _, _ in rows:
        y[int((t - base).total_seconds() // 3600)] += 1
    X = np.array([[1.0, t.hour, 1.0 if t.weekday() >= 5 else 0.0] for t in hours])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    assert abs(float(coef.intercept) - b[0]) < 1e-6
    assert abs(float(coef.hour_coef) - b[1]) < 1e-6
    assert abs(float(coef.weekend_coef) - b[2]) < 1e-6


def test_forecast_vs_actuals_cases(spark):
    h = dt.datetime(2024, 1, 1, 10)
    act = spark.createDataFrame([(h, "a", 4, Decimal("10.00")), (h + dt.timedelta(hours=1), "a", 0, Decimal("0.00")),
                                 (h + dt.timedelta(hours=3), "a", 2, Decimal("5.00"))],
                                "hour_bucket timestamp, category string, actual_orders long, actual_revenue_usd decimal(18,2)")
    fcs = spark.createDataFrame([(h, "a", Decimal("3.00"), Decimal("3.45"), Decimal("2.55")),
                                 (h + dt.timedelta(hours=1), "a", Decimal("1.00"), Decimal("1.15"), Decimal("0.85")),
                                 (h + dt.timedelta(hours=2), "a", Decimal("2.00"), Decimal("2.30"), Decimal("1.70"))],
                                "forecast_time timestamp, category string, predicted_orders decimal(12,2), "
                                "confidence_upper decimal(12,2), confidence_lower decimal(12,2)")
    out = {r.hour_bucket: r for r in fc.forecast_vs_actuals(act, fcs).collect()}
    both, zero, fonly, aonly = (out[h], out[h + dt.timedelta(hours=1)], out[h + dt.timedelta(hours=2)],
                                out[h + dt.timedelta(hours=3)])
    assert both.absolute_error == Decimal("1.00") and both.absolute_pct_error == Decimal("25.0000")
    assert not both.within_confidence_interval
    assert zero.absolute_pct_error is None and zero.absolute_error == Decimal("1.00")
    assert fonly.actual_orders == 0 and not fonly.within_confidence_interval
    assert aonly.predicted_orders is None and aonly.absolute_error == Decimal("2.00")
    acc = fc.accuracy(fc.forecast_vs_actuals(act, fcs)).first()
    assert acc.rows == 4 and acc.mae == Decimal("1.5000")
    assert F is not None
