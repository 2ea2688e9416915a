"""The stacked fraud ensemble and the graph challenger.

Base learners are two gradient-boosted tree models and a random forest. Their out-of-fold
probabilities (5 folds, each with its share of both classes) train a class-weighted logistic
meta-learner by Newton steps. The minority is raised by synthetic rows first.

Training rows are a bounded sample of the labelled ones (``Effort.sample_rows``, those of smallest
hash), so a fit is one task of known size and the eighteen fits run side by side. The
scoring of all rows and the Newton sums are spread over all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.operators import boosting, logistic, neighbours
from orderflow.operators.ranking import global_position
from orderflow.session import cut_lineage

FOLDS = 5
SEED = 42


@dataclass(frozen=True)
class Effort:
    """How long the learners train, and on how many rows; the defaults are the full training run."""
    boosting_rounds: int = 500
    forest_trees: int = 200
    meta_iterations: int = 1000
    sample_rows: int = 20_000


NO_MODEL_SCORE = 0.5


def base_learners(effort: Effort) -> dict[str, boosting.Learner]:
    """The three learners with their fixed settings."""
    return {
        "p_gbt": boosting.Learner(effort.boosting_rounds, depth=6, positive_weight=66),
        "p_sgb": boosting.Learner(effort.boosting_rounds, depth=6, least=20 * 0.25),
        "p_rf": boosting.Learner(effort.forest_trees, depth=8, rate=0, cols=0.26),
    }


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = FOLDS) -> DataFrame:
    """``fold`` 0..folds-1 with equal shares of both classes: rows are numbered by (label, key
    hash), and neighbours go to different folds."""
    mixed = df.withColumn("__mix", F.xxhash64(key))
    return global_position(mixed, [label, "__mix", key], "__at").withColumn("fold", (F.col("__at") % folds).cast("int")).drop("__mix", "__at")


def _fit_one(tasks: list[tuple[str, int]], learners: dict[str, boosting.Learner], key: str):
    """One fit: the model as bytes (trained on all rows) or the probabilities of the fold left out."""
    def step(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)                      # rows arrive in any order
        number = table.column("fit")[0].as_py()
        name, fold = tasks[number]
        x = np.array(table.column("x").to_pylist(), float)
        y, folds = table.column("y").to_numpy(), table.column("fold").to_numpy()
        model = boosting.fit(x[folds != fold], y[folds != fold], learners[name], zlib.crc32(f"{SEED} {name} {fold}".encode()))
        if fold < 0:
            return pa.table({"learner": [name], key: pa.array([None], pa.string()), "p": pa.array([None], pa.float64()), "model": pa.array([boosting.to_bytes(model)], pa.binary())})
        out = folds == fold
        ids = table.column(key).filter(pa.array(out))
        return pa.table({"learner": [name] * len(ids), key: ids, "p": boosting.predict(model, x[out]), "model": pa.nulls(len(ids), pa.binary())})
    return step


def stacked_ensemble(train: DataFrame, test: DataFrame, cols: Sequence[str], key: str = "order_id",
                     label: str = "is_fraud", effort: Effort = Effort()) -> DataFrame:
    """Fit on ``train`` (out-of-fold stacking) and score ``test``: (key, label, probability). Null values
    are 0; without both classes in the sample every probability is 0.5."""
    cols, learners = list(cols), base_learners(effort)
    as_double = lambda df: df.select(key, F.col(label).cast("int").alias(label), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    sample = cut_lineage(as_double(train.filter(F.col(label).isNotNull())).orderBy(F.xxhash64(key), key).limit(effort.sample_rows))
    scored = as_double(test)
    if sample.select(label).distinct().count() < 2:
        return scored.select(key, label, F.lit(NO_MODEL_SCORE).alias("fraud_probability"))
    raised = as_double(neighbours.oversample(sample, cols, id_col=key, label=label))
    folded = cut_lineage(stratified_folds(raised, label, key))

    tasks = [(name, fold) for name in learners for fold in (*range(FOLDS), -1)]
    rows = folded.select(F.col(key).cast("string").alias(key), "fold", F.col(label).alias("y"), F.array(*cols).alias("x"))
    dealt = rows.withColumn("fit", F.explode(F.array(*[F.lit(i) for i in range(len(tasks))])))
    fitted = cut_lineage(dealt.groupBy("fit").applyInArrow(_fit_one(tasks, learners, key), f"learner string, {key} string, p double, model binary"))

    # The meta-learner on out-of-fold probabilities.
    names = list(learners)
    held = fitted.filter("model IS NULL").groupBy(key).agg(*[F.max(F.when(F.col("learner") == n, F.col("p"))).alias(n) for n in names])
    stacked = cut_lineage(held.join(folded.select(F.col(key).cast("string").alias(key), label), key))
    meta = logistic.newton(stacked, names, F.lit(0), F.col(label), steps=effort.meta_iterations, until=1e-10)

    # Three models, bounded by their trees and nodes, go to the tasks that score.
    models = {r.learner: boosting.from_bytes(r.model) for r in fitted.filter("model IS NOT NULL").select("learner", "model").collect()}

    def score(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols], 1)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(label), *(pa.array(boosting.predict(models[n], x)) for n in names)], names=[key, label, *names])

    kind = scored.schema[key].dataType.simpleString()
    out = scored.mapInArrow(score, f"{key} {kind}, {label} int, " + ", ".join(f"{n} double" for n in names))
    return out.select(key, label, F.coalesce(logistic.probability(meta, names, F.lit(0)), F.lit(NO_MODEL_SCORE)).alias("fraud_probability"))


def half_of(key: str):
    """0 or 1 by the first digit of the key's hash."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 1), 16, 10).cast("int") % 2)


def challenger(nodes: DataFrame, cols: Sequence[str] = ("amount_std", "hop1_mean", "hop2_mean", "degree"),
               key: str = "order_id", label: str = "is_fraud") -> DataFrame:
    """Logistic model on neighbour features: each half of the orders (by a hash of the key) is scored by
    the model of the other half; 0.5 where that has a single class. Both fits share every step."""
    filled = cut_lineage(nodes.fillna(0.0, subset=list(cols)).withColumn(label, F.col(label).cast("double")).withColumn("__half", half_of(key)))
    coefs = logistic.newton(filled, cols, 1 - F.col("__half"), F.col(label))
    score = F.coalesce(logistic.probability(coefs, cols, F.col("__half")), F.lit(NO_MODEL_SCORE))
    return filled.select(key, score.alias("challenger_score"))
