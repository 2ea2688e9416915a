"""Newton steps and histogram trees against plain recomputations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orderflow.operators import boosting, logistic, modeling


def test_newton_finds_the_optimum_of_each_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -2.0] - 1)))).astype(int)
    fit = np.arange(400) % 2
    df = spark.createDataFrame([(int(k), int(t), float(a), float(b)) for k, t, (a, b) in zip(fit, y, x)] + [(5, 1, 0.0, 0.0), (5, 1, 1.0, 0.0)], "k int, y int, a double, b double")
    got = logistic.newton(df, ["a", "b"], F.col("k"), F.col("y"), steps=50, until=1e-12)
    assert set(got) == {0, 1}                      # fit 5 has a single class
    for k, beta in got.items():
        xs, ys = np.c_[np.ones(200), x[fit == k]], y[fit == k]
        w = np.where(ys == 1, 200 / (2 * ys.sum()), 200 / (2 * (200 - ys.sum())))
        gradient = xs.T @ (w * (ys - 1 / (1 + np.exp(-xs @ beta)))) - logistic.RIDGE * np.array([0, *beta[1:]])
        assert np.abs(gradient).max() < 1e-7


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    for learner in (boosting.Learner(40, 4), boosting.Learner(30, 6, rate=0, cols=0.5)):
        model = boosting.from_bytes(boosting.to_bytes(boosting.fit(x, y, learner, 1)))
        p = boosting.predict(model, x)
        assert ((p > 0.5) == y).mean() > 0.9
        for i in range(0, 600, 97):
            total = 0.0
            for t in range(learner.trees):
                node = 0
                for _ in range(learner.depth):
                    edges = model["edges"][model["feature"][t, node]]
                    code = sum(e < x[i, model["feature"][t, node]] for e in edges)
                    node = 2 * node + (2 if code > model["cut"][t, node] else 1)
                total += model["value"][t, node]
            assert abs(p[i] - (1 / (1 + np.exp(-total)) if learner.rate else total)) < 1e-9


def test_a_tree_takes_the_best_split():
    codes = np.array([[0, 1], [1, 0], [2, 1], [3, 0]])
    feature, cut, value = boosting.grow(codes, np.array([1.0, 1.0, -1.0, -1.0]), np.ones(4), 1, lambda w: np.ones((w, 2), bool), 0.0, 1.0)
    assert (feature[0], cut[0]) == (0, 1) and value[1:].tolist() == [1.0, -1.0]


def test_ensemble_ranks_unseen_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(f"o{i}", int(a + b * c > 1.2), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(rng.normal(size=(1500, 3)))]
    df = spark.createDataFrame(rows, "order_id string, is_fraud int, a double, b double, c double")
    effort = modeling.Effort(boosting_rounds=60, forest_trees=40)
    out = modeling.stacked_ensemble(df.limit(1000), df.filter("CAST(substr(order_id, 2) AS INT) >= 1000"), ["a", "b", "c"], effort=effort).collect()
    pos = sorted(r.fraud_probability for r in out if r.is_fraud)
    neg = [r.fraud_probability for r in out if not r.is_fraud]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert len(out) == 500 and auc > 0.93
    one = modeling.stacked_ensemble(df.filter("is_fraud = 0"), df, ["a", "b", "c"], effort=effort).agg({"fraud_probability": "sum"}).first()[0]
    assert one == 750.0
