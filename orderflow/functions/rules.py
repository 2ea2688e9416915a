"""Business rules as Catalyst expressions.

Every rule is a pure column expression, so it runs inside whole-stage codegen
next to the scan. There is no Python on the row path.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# ---------------------------------------------------------------------------
# These must equal the reference application's thresholds,
# labels and sentences for results to match. Kept together, in natural order.
# ---------------------------------------------------------------------------
VALID_AMOUNT_LOW = 0                 # amount must be > this
VALID_AMOUNT_HIGH = 100000           # amount must be < this
HIGH_VALUE_WAREHOUSE = 1000          # warehouse "high value": amount > 1000
LOOKBACK_DAYS = 30
FRAUD_SCORE_THRESHOLD = 0.5
RISK_CRITICAL_ABOVE = 0.8
RISK_HIGH_ABOVE = 0.4
RISK_LEVELS = ("CRITICAL", "HIGH", "LOW")
RISK_DISPLAY = {"CRITICAL": "🔴 CRITICAL", "HIGH": "🟠 HIGH", "OTHER": "🟡 FLAGGED"}
LOSS_FACTOR = {"CRITICAL": "0.95", "HIGH": "0.70", "OTHER": "0.30"}
FRAUD_PATTERNS = ("COORDINATED_ATTACK", "STOLEN_CARD", "BOT_ACTIVITY",
                  "ACCOUNT_TAKEOVER", "LOCATION_FRAUD", "ANOMALY")
PRODUCT_TIERS = (("HIGH_RISK_PRODUCT", 20), ("MEDIUM_RISK_PRODUCT", 10), ("LOW_RISK_PRODUCT", None))
VALUE_TIERS = (("PLATINUM", 10000), ("GOLD", 5000), ("SILVER", 1000), ("BRONZE", None))
USER_SEGMENTS = ("BANNED", "HIGH_RISK", "MEDIUM_RISK", "TRUSTED", "STANDARD")
TRIAGE_BLOCK_ABOVE = 0.9
TRIAGE_APPROVE_BELOW = 0.2
DECISION_BLOCK_ABOVE = 0.5
DECISION_APPROVE_BELOW = 0.6
DECISIONS = ("FINAL_BLOCK", "FINAL_APPROVE", "HUMAN_REVIEW", "INVESTIGATE")
DRIVER_VELOCITY_ABOVE = 5
DRIVER_AMOUNT_ABOVE = 1000
DRIVER_TEXT = ("High Velocity ({n})", "Location Mismatch", "High Ticket Value")
DRIVER_NONE = "Normal Behavioral Profile"
EVIDENCE_TEXT = {
    "age_warning": "WARNING: Account is only {n} day(s) old — very new account.",
    "age_signal": "SIGNAL: Relatively new account ({n} days). Moderate risk signal.",
    "age_ok": "OK: Established account ({n} days) with prior order history.",
    "proxy_warning": "WARNING: Transaction originated from a known high-risk proxy or VPN provider.",
    "proxy_ok": "OK: IP address is not associated with proxy or VPN services.",
    "device_signal": "SIGNAL: Device type is unrecognized or spoofed.",
    "device_ok": "OK: Known device type '{device}' used for this transaction.",
    "velocity_warning": ("WARNING: User placed {n} orders in the last hour — "
                         "extremely high velocity, possible bot activity."),
    "velocity_signal": "SIGNAL: User placed {n} orders in the last hour — elevated velocity.",
    "velocity_ok": "OK: Normal order velocity ({n} orders/hour).",
    "location_warning": ("WARNING: Billing address location does not match the IP geolocation — "
                         "possible stolen card or account takeover."),
    "location_ok": "OK: Billing location matches IP geolocation.",
}
REASONING_TEXT = {
    "triage_block": ("Both models report critical risk (Ensemble: {e}, GNN: {g}). "
                     "Immediate block — no investigation needed."),
    "triage_approve": "Both models confirm very low risk (Ensemble: {e}, GNN: {g}). Auto-approved.",
    "rule_block": ("Rule-based fallback: Multiple WARNING signals combined with elevated "
                   "model scores (Ensemble: {e}, GNN: {g}). Blocking."),
    "rule_approve": ("Rule-based fallback: Established account signals outweigh model flags. "
                     "Scores below threshold (Ensemble: {e}, GNN: {g})."),
    "rule_review": "Rule-based fallback: Evidence is contradictory. Sending to human review queue.",
}
EVIDENCE_AGE_WARNING_BELOW = 7
EVIDENCE_AGE_SIGNAL_BELOW = 30
EVIDENCE_VELOCITY_WARNING_ABOVE = 10
EVIDENCE_VELOCITY_SIGNAL_ABOVE = 5
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _fmt(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` placeholders with columns via ``format_string``."""
    order = []
    pattern = template.replace("%", "%%")
    for name in cols:
        token = "{" + name + "}"
        pattern = pattern.replace(token, "%s")
        order.append(cols[name])
    return F.format_string(pattern, *order)


def is_fraud(score, threshold: float = FRAUD_SCORE_THRESHOLD) -> Column:
    return _c(score) > F.lit(threshold)


def risk_level(score) -> Column:
    s = _c(score)
    return (F.when(s > RISK_CRITICAL_ABOVE, "CRITICAL")
            .when(s > RISK_HIGH_ABOVE, "HIGH")
            .otherwise("LOW"))


def risk_display(level) -> Column:
    lv = _c(level)
    return (F.when(lv == "CRITICAL", RISK_DISPLAY["CRITICAL"])
            .when(lv == "HIGH", RISK_DISPLAY["HIGH"])
            .otherwise(RISK_DISPLAY["OTHER"]))


def fraud_pattern(mismatch, velocity, high_value, late_night) -> Column:
    """Warehouse ladder; first matching rule wins."""
    m, v, hv, ln = _c(mismatch), _c(velocity), _c(high_value), _c(late_night)
    return (F.when(m & (v > 5), "COORDINATED_ATTACK")
            .when(m & hv, "STOLEN_CARD")
            .when(v > 10, "BOT_ACTIVITY")
            .when(hv & ln, "ACCOUNT_TAKEOVER")
            .when(m, "LOCATION_FRAUD")
            .otherwise("ANOMALY"))


def fraud_pattern_online(mismatch, velocity, amount, hour) -> Column:
    """Scoring-time ladder: high value is amount > 1000, late night is hour < 6."""
    m = _c(mismatch).cast("boolean")
    return fraud_pattern(m, _c(velocity), _c(amount) > HIGH_VALUE_WAREHOUSE, _c(hour) < 6)


def estimated_loss(level, amount) -> Column:
    lv, amt = _c(level), _c(amount)
    return (F.when(lv == "CRITICAL", amt * F.lit(Decimal(LOSS_FACTOR["CRITICAL"])))
            .when(lv == "HIGH", amt * F.lit(Decimal(LOSS_FACTOR["HIGH"])))
            .otherwise(amt * F.lit(Decimal(LOSS_FACTOR["OTHER"])))).cast(DecimalType(16, 4))


def product_risk_tier(fraud_rate_pct) -> Column:
    r = _c(fraud_rate_pct)
    return (F.when(r > 20, "HIGH_RISK_PRODUCT")
            .when(r > 10, "MEDIUM_RISK_PRODUCT")
            .otherwise("LOW_RISK_PRODUCT"))


def reputation_score(fraud_count, mismatch_count, peak_velocity, days_as_customer, total_orders) -> Column:
    raw = (F.lit(100)
           - _c(fraud_count) * 20
           - _c(mismatch_count) * 5
           - F.when(_c(peak_velocity) > 10, 15).otherwise(0)
           + F.when(_c(days_as_customer) > 365, 10).otherwise(0)
           + F.when(_c(total_orders) > 20, 5).otherwise(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("int")


def user_segment(fraud_count, avg_score, mismatch_count, total_orders) -> Column:
    fc, avg, mc, n = _c(fraud_count), _c(avg_score), _c(mismatch_count), _c(total_orders)
    return (F.when(fc > 2, "BANNED")
            .when((fc > 0) | (avg > 0.6), "HIGH_RISK")
            .when((avg > 0.3) | (mc > 2), "MEDIUM_RISK")
            .when((n > 20) & (fc == 0), "TRUSTED")
            .otherwise("STANDARD"))


def customer_value_tier(total_spend) -> Column:
    s = _c(total_spend)
    return (F.when(s > 10000, "PLATINUM")
            .when(s > 5000, "GOLD")
            .when(s > 1000, "SILVER")
            .otherwise("BRONZE"))


def triage(ensemble, gnn) -> Column:
    e, g = _c(ensemble), _c(gnn)
    return (F.when((e > TRIAGE_BLOCK_ABOVE) & (g > TRIAGE_BLOCK_ABOVE), "FINAL_BLOCK")
            .when((e < TRIAGE_APPROVE_BELOW) & (g < TRIAGE_APPROVE_BELOW), "FINAL_APPROVE")
            .otherwise("INVESTIGATE"))


def evidence(account_age_days, is_proxy, device, orders_last_hour, location_mismatch) -> Column:
    """The five graded findings, in order, as an array of sentences."""
    age, dev, vel = _c(account_age_days), _c(device), _c(orders_last_hour)
    t = EVIDENCE_TEXT
    age_s, vel_s = age.cast("string"), vel.cast("string")
    return F.array(
        F.when(age < EVIDENCE_AGE_WARNING_BELOW, _fmt(t["age_warning"], n=age_s))
         .when(age < EVIDENCE_AGE_SIGNAL_BELOW, _fmt(t["age_signal"], n=age_s))
         .otherwise(_fmt(t["age_ok"], n=age_s)),
        F.when(_c(is_proxy), F.lit(t["proxy_warning"])).otherwise(F.lit(t["proxy_ok"])),
        F.when(dev == "unknown", F.lit(t["device_signal"]))
         .otherwise(_fmt(t["device_ok"], device=dev)),
        F.when(vel > EVIDENCE_VELOCITY_WARNING_ABOVE, _fmt(t["velocity_warning"], n=vel_s))
         .when(vel > EVIDENCE_VELOCITY_SIGNAL_ABOVE, _fmt(t["velocity_signal"], n=vel_s))
         .otherwise(_fmt(t["velocity_ok"], n=vel_s)),
        F.when(_c(location_mismatch), F.lit(t["location_warning"]))
         .otherwise(F.lit(t["location_ok"])),
    )


def decision(evidence_arr, ensemble, gnn) -> Column:
    ev, e, g = _c(evidence_arr), _c(ensemble), _c(gnn)
    has_warning = F.exists(ev, lambda s: s.contains("WARNING"))
    has_ok = F.exists(ev, lambda s: s.startswith("OK"))
    return (F.when(has_warning & ((e > DECISION_BLOCK_ABOVE) | (g > DECISION_BLOCK_ABOVE)), "FINAL_BLOCK")
            .when(has_ok & (e < DECISION_APPROVE_BELOW) & (g < DECISION_APPROVE_BELOW), "FINAL_APPROVE")
            .otherwise("HUMAN_REVIEW"))


def reasoning(triage_col, decision_col, ensemble_2dp, gnn_2dp) -> Column:
    """Decision text; the scores are passed already rounded to two decimals."""
    t, d = _c(triage_col), _c(decision_col)
    e, g = _c(ensemble_2dp).cast("string"), _c(gnn_2dp).cast("string")
    r = REASONING_TEXT
    return (F.when(t == "FINAL_BLOCK", _fmt(r["triage_block"], e=e, g=g))
            .when(t == "FINAL_APPROVE", _fmt(r["triage_approve"], e=e, g=g))
            .when(d == "FINAL_BLOCK", _fmt(r["rule_block"], e=e, g=g))
            .when(d == "FINAL_APPROVE", _fmt(r["rule_approve"], e=e, g=g))
            .otherwise(F.lit(r["rule_review"])))


def top_drivers(velocity, location_mismatch, amount) -> Column:
    v, m, a = _c(velocity), _c(location_mismatch), _c(amount)
    found = F.array_compact(F.array(
        F.when(v > DRIVER_VELOCITY_ABOVE, F.format_string("High Velocity (%s)", v.cast("string"))),
        F.when(m == 1, F.lit(DRIVER_TEXT[1])),
        F.when(a > DRIVER_AMOUNT_ABOVE, F.lit(DRIVER_TEXT[2])),
    ))
    return F.when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.lit(DRIVER_NONE)))


def final_label(score, threshold, agent_decision) -> Column:
    return (_c(score) > _c(threshold)) | F.coalesce(_c(agent_decision) == "FINAL_BLOCK", F.lit(False))
