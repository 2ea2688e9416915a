"""Data tests as DataFrames of violating rows (empty = test passes)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.rules import FRAUD_SCORE_THRESHOLD, RISK_LEVELS


def unique_not_null(df: DataFrame, key: str) -> DataFrame:
    """Keys that are NULL or appear more than once, with their copy count."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return counts.filter(F.col(key).isNull() | (F.col("copies") > 1))


def accepted_values(df: DataFrame, col: str, allowed: Sequence[str] = RISK_LEVELS,
                    key: str = "order_id") -> DataFrame:
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(*allowed)).select(key, col)


def score_in_unit_range(df: DataFrame, col: str = "fraud_score", key: str = "order_id") -> DataFrame:
    return df.filter(F.col(col).isNull() | (F.col(col) < 0) | (F.col(col) > 1)).select(key, col)


def no_future(df: DataFrame, as_of: Column, ts_col: str = "timestamp", key: str = "order_id") -> DataFrame:
    return df.filter(F.col(ts_col) > as_of).select(key, ts_col)


def label_consistent(df: DataFrame, threshold: float = FRAUD_SCORE_THRESHOLD,
                     key: str = "order_id") -> DataFrame:
    """Rows whose fraud label disagrees with ``score > threshold``."""
    expected = F.col("fraud_score") > F.lit(threshold)
    return (df.filter(~F.col("is_fraud").eqNullSafe(expected))
              .select(key, "fraud_score", "is_fraud"))
