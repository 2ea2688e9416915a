"""Quality rules: fixed base rules and gradient-boosted trees with monotone constraints.

The trees are fitted once, on a bounded labelled sample (``TRAIN_ROWS`` ids of
smallest hash among all labelled rows), flattened into numpy node arrays and
applied to every document inside the same map that computes its statistics.

Defined cases: a null or empty text has no words and fails the base rules;
without usable labels (empty table, one class) the verdict is the base rules
alone; repeated rows are judged each on its own; a row with a null id is judged
like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm import docstats as ds
from orderflow.llm import trees

TRAIN_ROWS = 20_000         # bound of the labelled sample that is fitted
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
KEEP_AT = 0.5               # keep a document whose score reaches this
# More of these never makes a document better; more distinct words never makes it worse.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "upper_share": -1, "bang_per_word": -1, "distinct_word_share": 1}


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> trees.Nodes:
    x, y = ds.labelled_sample(docs, labels, rows)
    return trees.boost(x, y, monotone={ds.FEATURES.index(k): v for k, v in MONOTONE.items()})


SCHEMA = ("doc_id long, " + ", ".join(f"{c} long" for c in ds.BASE) + ", base_failed boolean, score double, kept boolean")


def judge(stats: dict[str, np.ndarray], model: trees.Nodes) -> dict[str, np.ndarray]:
    n = stats["n_words"]
    failed = (n < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    if len(model.roots):
        score = model.score(np.stack([stats[c] for c in ds.FEATURES], 1).astype(float))
    else:
        score = np.ones(len(n))
    return {"base_failed": failed, "score": score, "kept": ~failed & (score >= KEEP_AT)}


def assess(docs: DataFrame, model: trees.Nodes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics, base verdict, score and final verdict of every row; one map, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = ds.batch_stats(b.column(1))
            s |= judge(s, model)
            names = (*ds.BASE, "base_failed", "score", "kept")
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[c]) for c in names)], names=["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: trees.Nodes, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, in one map."""
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = ds.batch_stats(b.column(at).cast(pa.string()))
            yield b.filter(pa.array(judge(s, model)["kept"]))

    return docs.mapInArrow(run, docs.schema)
