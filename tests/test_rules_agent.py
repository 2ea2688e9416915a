"""Rule ladders and the three agent demo cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.functions import rules


def _agent_rows(spark, rows):
    df = spark.createDataFrame(rows, "order_id string, ens double, gnn double, age int, proxy boolean, "
                                     "device string, vel int, mis boolean")
    tri = rules.triage("ens", "gnn")
    ev = rules.evidence("age", "proxy", "device", "vel", "mis")
    inv = tri == "INVESTIGATE"
    return df.select("order_id", tri.alias("triage"),
                     F.when(inv, ev).otherwise(F.array().cast("array<string>")).alias("evidence"),
                     F.when(inv, rules.decision(ev, "ens", "gnn")).otherwise(tri).alias("decision"))


def test_agent_demo_cases(spark):
    out = {r.order_id: r for r in _agent_rows(spark, [
        ("ORD-001", 0.95, 0.92, 1, True, "unknown", 15, True),
        ("ORD-552", 0.65, 0.30, 2, True, "mobile", 3, False),
        ("ORD-999", 0.05, 0.08, 365, False, "desktop", 1, False),
    ]).collect()}
    assert out["ORD-001"].decision == "FINAL_BLOCK" and out["ORD-001"].evidence == []
    assert out["ORD-552"].triage == "INVESTIGATE" and out["ORD-552"].decision == "FINAL_BLOCK"
    assert out["ORD-552"].evidence[0] == "WARNING: Account is only 2 day(s) old — very new account."
    assert out["ORD-552"].evidence[2] == "OK: Known device type 'mobile' used for this transaction."
    assert len(out["ORD-552"].evidence) == 5
    assert out["ORD-999"].decision == "FINAL_APPROVE" and out["ORD-999"].evidence == []


def test_review_when_contradictory(spark):
    # warning present but both scores <= 0.5, and scores not both < 0.6 -> review
    r = _agent_rows(spark, [("X", 0.58, 0.45, 3, False, "mobile", 1, False)]).first()
    assert r.decision == "FINAL_BLOCK"    # a warning and a score above 0.5
    r = _agent_rows(spark, [("Z", 0.30, 0.40, 3, False, "mobile", 1, False)]).first()
    assert r.decision == "FINAL_APPROVE"  # warning, but scores low and OK signals present
    r = _agent_rows(spark, [("Y", 0.3, 0.7, 100, False, "mobile", 1, False)]).first()
    assert r.decision == "HUMAN_REVIEW"   # no warning, gnn >= 0.6


def test_pattern_ladder_order(spark):
    df = spark.createDataFrame([
        (True, 6, True, True), (True, 1, True, True), (False, 11, True, True),
        (False, 1, True, True), (True, 1, False, False), (False, 1, False, False)],
        "m boolean, v int, hv boolean, ln boolean")
    got = [r.p for r in df.select(rules.fraud_pattern("m", "v", "hv", "ln").alias("p")).collect()]
    assert got == ["COORDINATED_ATTACK", "STOLEN_CARD", "BOT_ACTIVITY", "ACCOUNT_TAKEOVER",
                   "LOCATION_FRAUD", "ANOMALY"]


def test_reputation_clamped(spark):
    df = spark.createDataFrame([(10, 0, 0, 0, 0), (0, 0, 0, 400, 30), (0, 1, 11, 0, 1)],
                               "f int, m int, p int, d int, n int")
    got = [r.s for r in df.select(rules.reputation_score("f", "m", "p", "d", "n").alias("s")).collect()]
    assert got == [0, 100, 80]


def test_top_drivers(spark):
    df = spark.createDataFrame([(7, 1, 5000.0), (0, 0, 10.0), (6, 0, 10.0)], "v int, m int, a double")
    got = [r.d for r in df.select(rules.top_drivers("v", "m", "a").alias("d")).collect()]
    assert got == [["High Velocity (7)", "Location Mismatch", "High Ticket Value"],
                   ["Normal Behavioral Profile"], ["High Velocity (6)"]]
