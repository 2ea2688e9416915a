"""Exact distribution statistics from cumulative counts (no per-group value maps)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.operators.ranking import cumulative_by_value


def quantiles_exact(df: DataFrame, parts: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles (type 7, as pandas/numpy) per group.

    Returns one row per (parts, q) with ``quantile``. Order statistics are
    located through cumulative counts by value, so no group's values are
    ever gathered in one place.
    """
    parts = list(parts)
    return quantiles_of_counts(cumulative_by_value(df, parts, value, None, descending=False), parts, value, qs)


def quantiles_of_counts(c: DataFrame, parts: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """``quantiles_exact`` from the (ascending) cumulative counts of the values."""
    c = c.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    h = (F.col("n_total") - 1).cast("double") * F.col("q")
    lo_rank, hi_rank = F.floor(h), F.ceil(h)
    start, stop = F.col("n_beyond"), F.col("n_beyond") + F.col("n_eq")
    v = F.col(value).cast("double")
    hit_lo = (start <= lo_rank) & (lo_rank < stop)
    hit_hi = (start <= hi_rank) & (hi_rank < stop)
    picked = c.filter(hit_lo | hit_hi).select(
        *parts, "q", h.alias("__h"), F.when(hit_lo, v).alias("__lo"), F.when(hit_hi, v).alias("__hi"))
    g = picked.groupBy(*parts, "q").agg(F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi"),
                                         F.max("__h").alias("__h"))
    frac = F.col("__h") - F.floor(F.col("__h"))
    return g.select(*parts, "q", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * frac).alias("quantile"))


def group_median(df: DataFrame, parts: Sequence[str], value: str, out_col: str, scale: int = 3) -> DataFrame:
    """(parts..., out_col): exact continuous median per group, DECIMAL(18, scale).

    The median of values with s decimals has at most s + 1 decimals, so the
    interpolated double rounded to ``scale`` is exact.
    """
    q = quantiles_exact(df, parts, value, [0.5])
    return q.select(*parts, F.round(F.col("quantile"), scale).cast(f"decimal(18,{scale})").alias(out_col))


def unpivot(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
            name: str = "feature", value: str = "value") -> DataFrame:
    """Long format (id..., feature, value double) with one ``stack`` per row."""
    return df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in value_cols]) \
             .unpivot(list(id_cols), list(value_cols), name, value)

