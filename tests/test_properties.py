"""Distributed operators against brute force on small random fixtures
(hot keys, ties and NULLs included)."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orderflow.functions.exact import ratio_round
from orderflow.operators import evaluation, graph
from orderflow.operators.ranking import with_pct_rank_average, with_position
from orderflow.operators.stats import quantiles_exact
from orderflow.operators.velocity import trailing_count


def test_trailing_count_matches_range_frame(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else rnd.choice(["a", "b", None])  # one key holds 2/3 of the rows
        t = rnd.choice([0, 59_999_999, 60_000_000, 120_000_000]) + rnd.randrange(0, 400_000_000, 1_000_000)
        rows.append((i, key, t, rnd.randint(0, 1)))
    df = spark.createDataFrame(rows, "id long, k string, t long, w int")
    width = 59_999_999
    for m in (1, 6, 12):
        got = {r.id: r.c for r in trailing_count(df, ["k"], "t", width, "c", sub_buckets=m).collect()}
        got_s = {r.id: r.c for r in trailing_count(df, ["k"], "t", width, "c", weight="w", strict=True,
                                                   sub_buckets=m).collect()}
        for i, k, t, _ in rows:
            same = [(t2, w2) for _, k2, t2, w2 in rows if k2 == k]
            assert got[i] == sum(1 for t2, _ in same if t - width <= t2 <= t), (m, i)
            assert got_s[i] == sum(w2 for t2, w2 in same if t - width <= t2 < t), (m, i)


def test_pct_rank_and_position(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([1.5, 2.0, 2.0, 7.25, None]) if i % 4 else rnd.random() for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    got = {r.id: r.p for r in with_pct_rank_average(df, "v", "p").collect()}
    expect = pd.Series(vals, dtype="float64").rank(pct=True).fillna(0.5)
    for i in range(len(vals)):
        assert abs(got[i] - expect[i]) < 1e-12
    pos = {r.id: r.position for r in with_position(df.fillna(0.0), "v", "id").collect()}
    order = sorted(range(len(vals)), key=lambda i: (vals[i] if vals[i] is not None else 0.0, i))
    assert [pos[i] for i in order] == list(range(len(vals)))


def test_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(1)
    g = np.where(rnd.random(500) < 0.7, "hot", "cold")
    v = np.round(rnd.normal(size=500), 2)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    got = {(r.g, r.q): r.quantile for r in quantiles_exact(df, ["g"], "v", [0.25, 0.5, 0.95]).collect()}
    for grp in ("hot", "cold"):
        for q in (0.25, 0.5, 0.95):
            assert abs(got[(grp, q)] - np.quantile(v[g == grp], q)) < 1e-9


def test_ratio_round_half_away_from_zero(spark):
    rnd = random.Random(11)
    pairs = [(rnd.randint(-10**9, 10**9), rnd.randint(1, 10**6)) for _ in range(400)] + [(5, 1000), (-15, 1000), (1, 8)]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r.x for r in df.select(ratio_round("n", "d", 2).alias("x")).collect()]
    for (n, d), x in zip(pairs, got):
        q = (Decimal(abs(n)) / Decimal(d)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        assert x == (q if n >= 0 else -q)


def test_neighbour_mean_matches_pairs(spark):
    rnd = random.Random(5)
    rows = [(f"o{i}", rnd.choice(["u1", "u2", "u3", "u4"]), rnd.choice(["ip1", "ip2", "unknown", None, "ip3"]),
             float(rnd.randint(1, 100))) for i in range(120)]
    df = spark.createDataFrame(rows, "order_id string, user_id string, ip_address string, x double")
    got = {r.order_id: (r.m_degree, r.m) for r in graph.neighbour_mean(df, "x", "m").collect()}
    for o, u, ip, _ in rows:
        nb = [x2 for o2, u2, ip2, x2 in rows if o2 != o and (
            u2 == u or (ip is not None and ip != "unknown" and ip2 == ip))]
        deg, m = got[o]
        assert deg == len(nb)
        assert (m is None and not nb) or abs(m - sum(nb) / len(nb)) < 1e-9


def test_components_match_union_find(spark):
    rows = [("o1", "u1", "ipA"), ("o2", "u2", "ipA"), ("o3", "u2", "ipB"),   # chain through IP then user
            ("o4", "u9", "unknown"), ("o5", "u9", None),                      # joined by user only
            ("o6", "u6", "unknown"),                                           # isolated ('unknown' links nothing)
            ("o7", "u7", "ipC"), ("o8", "u8", "ipC")]                          # a pair
    # a long chain alternating user and IP links (diameter ~60)
    rows += [(f"c{i:03d}", f"cu{i // 2}", f"cip{(i + 1) // 2}") for i in range(120)]
    df = spark.createDataFrame(rows, "order_id string, user_id string, ip_address string")
    comp = {r.order_id: r.component for r in graph.connected_components(df).collect()}
    parent = {o: o for o, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (o, u, ip) in enumerate(rows):
        for o2, u2, ip2 in rows[i + 1:]:
            if u == u2 or (ip and ip != "unknown" and ip == ip2):
                a, b = find(o), find(o2)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for o, _, _ in rows:
        groups.setdefault(find(o), set()).add(o)
    for members in groups.values():
        assert {comp[m] for m in members} == {min(members)}


def test_metrics_match_brute_force(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 1), round(rnd.choice([0.1, 0.35, 0.5, 0.77]) if i % 2 else rnd.random(), 3),
             Decimal(rnd.randint(100, 99999)) / 100) for i in range(400)]
    df = spark.createDataFrame(rows, "y_true int, y_score double, amount decimal(12,2)")
    auc = evaluation.pr_roc_auc(df).first()
    y = np.array([r[0] for r in rows])
    s = np.array([r[1] for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    roc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(auc.roc_auc - round(roc, 6)) < 1e-6
    ap = 0.0
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        ap += (y[(s == t)].sum() / y.sum()) * (y[sel].sum() / sel.sum())
    assert abs(auc.pr_auc - round(ap, 6)) < 1e-6
    best = evaluation.best_cost_threshold(df).first()
    grid = np.linspace(0.0001, 0.9999, 1000)
    amounts = np.array([float(r[2]) for r in rows])
    costs = []
    for t in grid:
        pred = s >= t
        costs.append(Decimal(80) * int(((pred == 1) & (y == 0)).sum())
                     + sum(Decimal(str(r[2])) + 20 for r, p in zip(rows, pred) if r[0] == 1 and not p))
    i = int(np.argmin(costs))
    assert best.total_cost == costs[i] and abs(best.threshold - grid[i]) < 1e-15
    assert amounts.size == len(rows)
