"""Calendar helpers in the warehouse's conventions (UTC, 0 = Sunday)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def dow_sunday0(ts) -> Column:
    """Day of week with 0 = Sunday .. 6 = Saturday (Spark's is 1 = Sunday)."""
    return (F.dayofweek(_c(ts)) - 1).cast("int")


def is_weekend(ts) -> Column:
    return dow_sunday0(ts).isin(0, 6)


def is_late_night_warehouse(ts) -> Column:
    """Warehouse late night: hour 0-5."""
    return F.hour(_c(ts)).between(0, 5)


def is_late_night_model(hour) -> Column:
    """Model late night: hour >= 23 or <= 4."""
    h = _c(hour)
    return ((h >= 23) | (h <= 4)).cast("int")


def whole_days(later, earlier) -> Column:
    """Completed 24-hour days between two timestamps (interval DAY field)."""
    secs = F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))
    return F.floor(secs / F.lit(86_400_000_000)).cast("int")
