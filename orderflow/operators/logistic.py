"""Logistic regression by Newton steps on normal equations.

A step is one aggregate over the rows: the gradient and the Hessian of all fits together, a row a
fit, (d + 1)(d + 4) / 2 sums for d columns. Only these sums come to the driver, where a system of
d + 1 equations is solved. The steps are a fixed number, so a fit can be repeated anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 6
RIDGE = 1.0                     # on the weights of the columns, not on the intercept


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination; the matrix is positive definite, so no rows are swapped."""
    n = len(b)
    rows = [[*r, y] for r, y in zip(a, b)]
    for i in range(n):
        for r in range(i + 1, n):
            f = rows[r][i] / rows[i][i]
            rows[r] = [x - f * y for x, y in zip(rows[r], rows[i])]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))) / rows[i][i]
    return out


def probability(coefs: dict[int, list[float]], cols: Sequence[str], fit: Column) -> Column:
    """Probability by the fit of each row; null where there is none."""
    out = None
    for k, b in coefs.items():
        t = F.lit(b[0])
        for x, c in zip(cols, b[1:]):
            t = t + F.lit(c) * F.col(x)
        out = (F if out is None else out).when(fit == k, 1.0 / (1.0 + F.exp(-t)))
    return out if out is not None else F.lit(None).cast("double")


def newton(rows: DataFrame, cols: Sequence[str], fit: Column, label: Column, steps: int = STEPS, ridge: float = RIDGE,
           until: float = 0.0) -> dict[int, list[float]]:
    """Intercept and weights of every fit (the whole number ``fit``) whose rows have both labels; classes
    weigh alike: a row weighs n / (2 n of its class). ``rows`` are read once a step; no step
    follows one that moved no weight by more than ``until``."""
    y = label.cast("double")
    sizes = rows.groupBy(fit.alias("k")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {r.k: (r.pos, r.n) for r in sizes if 0 < r.pos < r.n}
    if not sizes:
        return {}
    weight = None
    for k, (pos, n) in sizes.items():
        weight = (F if weight is None else weight).when(fit == k, F.when(y == 1, F.lit(n / (2.0 * pos))).otherwise(F.lit(n / (2.0 * (n - pos)))))
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    d = len(x)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    coefs = {k: [0.0] * d for k in sizes}
    for _ in range(steps):
        p = probability(coefs, cols, fit)
        base = rows.select(fit.alias("k"), weight.alias("w"), y.alias("y"), p.alias("p"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).filter("w IS NOT NULL")
        h = F.col("w") * F.col("p") * (1 - F.col("p"))
        sums = base.groupBy("k").agg(*[F.sum(F.col("w") * (F.col("y") - F.col("p")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(d)],
                                     *[F.sum(h * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs]).collect()
        moved = 0.0
        for r in sums:
            b = coefs[r.k]
            a = [[r[f"h{min(i, j)}_{max(i, j)}"] + (ridge if i == j and i else 0.0) for j in range(d)] for i in range(d)]
            move = _solve(a, [r[f"g{i}"] - (ridge * b[i] if i else 0.0) for i in range(d)])
            coefs[r.k] = [u + v for u, v in zip(b, move)]
            moved = max(moved, *map(abs, move))
        if moved <= until:
            break
    return coefs
