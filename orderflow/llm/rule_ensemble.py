"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

1. Shallow trees are grown on a bounded labelled sample; every path from a root
   to a node becomes a conjunctive rule over document statistics.
2. Logistic weights of the rules are fitted with an L1 penalty (proximal
   gradient), which leaves a few dozen rules.
3. The rules become one Spark column expression, evaluated in the JVM.

Labels are learned only from rows whose ``crc32(doc_id as text) % 5`` is not 0.
Inputs of a score are the statistics of the text alone.

Defined cases: a null or empty text has all statistics 0 and is scored like any
other; without usable labels the score is the constant 0.5; repeated rows are
scored each on its own; a null id is held out = false and never learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm import docstats as ds
from orderflow.llm import trees

TRAIN_ROWS = 20_000         # bound of the labelled sample that is fitted
FOLDS = 5
PREDICT_AT = 0.3
TREES, DEPTH = 24, 3
PENALTY, STEPS = 2e-3, 600

Condition = tuple[str, bool, float]  # (statistic, at most?, threshold)


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self) -> Column:
        margin = F.lit(self.bias)
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for name, below, limit in conditions:
                holds = holds & ((F.col(name) <= F.lit(limit)) if below else (F.col(name) > F.lit(limit)))
            margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def tree_paths(nodes: trees.Nodes) -> list[tuple[Condition, ...]]:
    """Conjunctions of all root-to-node paths, tightened and without repeats."""
    found: dict[tuple[Condition, ...], None] = {}

    def walk(at: int, bounds: dict[tuple[str, bool], float]) -> None:
        if bounds:
            found.setdefault(tuple(sorted((n, below, v) for (n, below), v in bounds.items())))
        if nodes.left[at] == at:
            return
        name, limit = ds.FEATURES[nodes.feature[at]], float(nodes.threshold[at])
        walk(nodes.left[at], bounds | {(name, True): min(limit, bounds.get((name, True), limit))})
        walk(nodes.right[at], bounds | {(name, False): max(limit, bounds.get((name, False), limit))})

    for root in nodes.roots:
        walk(root, {})
    return list(found)


def rule_matrix(x: np.ndarray, rules: list[tuple[Condition, ...]]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, conditions in enumerate(rules):
        for name, below, limit in conditions:
            col = x[:, ds.FEATURES.index(name)]
            out[:, j] *= (col <= limit) if below else (col > limit)
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the bias is not penalised."""
    a = np.concatenate([np.ones((len(z), 1)), z], 1)
    scale = 4 * len(a) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = np.zeros(a.shape[1])
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -50, 50)))
        nxt = ahead - scale * (a.T @ (p - y)) / len(a)
        nxt[1:] = np.sign(nxt[1:]) * np.maximum(np.abs(nxt[1:]) - scale * penalty, 0)
        again = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = nxt + (momentum - 1) / again * (nxt - w), nxt, again
    return float(w[0]), w[1:]


def fit_sample(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if not len(y) or y.min() == y.max():
        return Ensemble(0.0, ())
    grown = trees.boost(x, y, rounds=TREES, depth=DEPTH, rate=0.2, share=0.5)
    rules = tree_paths(grown)
    if not rules:
        p = float(np.clip(y.mean(), 0.01, 0.99))
        return Ensemble(float(np.log(p / (1 - p))), ())
    bias, weights = lasso_logistic(rule_matrix(x, rules), y)
    return Ensemble(bias, tuple((float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ensemble:
    return fit_sample(*ds.labelled_sample(docs, labels, rows, learn=fold("id") != 0))


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: one map and one JVM projection."""
    scored = ds.document_stats(docs).withColumn("score", model.column())
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
