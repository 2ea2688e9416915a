"""Small DataFrame helpers shared by operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys match NULL keys (``<=>``), like GROUP BY does.

    Output has one copy of each key column, taken from the left side
    (or from whichever side is present for outer joins).
    """
    keys = list(keys)
    if not keys:
        raise ValueError("keys required")
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    joined = left.join(r, cond, how)
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        for k in keys:
            joined = joined.withColumn(k, F.coalesce(F.col(k), F.col(f"__r_{k}")))
    elif how in ("left_semi", "semi", "left_anti", "anti"):
        return joined
    return joined.drop(*[f"__r_{k}" for k in keys])
