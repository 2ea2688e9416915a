"""One-row statistics as literals.

A scalar subquery is re-planned (and re-run) at every place it is used, and a
literal is what partition pruning and constant folding work with. So a
one-row aggregate that feeds many expressions (the ``as_of`` clock, scaler
statistics, spine sums) is fetched once and used as literals. This moves a
handful of numbers through the driver, never data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> Row:
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected a one-row aggregate, got {len(rows)} rows")
    return rows[0]


def ts_literal(micros: int | None) -> Column:
    """TIMESTAMP literal from epoch microseconds (independent of time zones)."""
    if micros is None:
        return F.lit(None).cast("timestamp")
    return F.timestamp_micros(F.lit(int(micros)))
