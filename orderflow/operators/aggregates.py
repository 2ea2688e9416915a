"""Aggregate building blocks with warehouse semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def count_if(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as BIGINT."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def sum_if(cond: Column, value, out_type=DecimalType(18, 2)) -> Column:
    """``SUM(CASE WHEN cond THEN value ELSE 0 END)``."""
    return F.sum(F.when(cond, _c(value)).otherwise(F.lit(0))).cast(out_type)


def mode_smallest(col) -> Column:
    """Most frequent non-NULL value; ties go to the smallest value."""
    return F.mode(_c(col), True)

