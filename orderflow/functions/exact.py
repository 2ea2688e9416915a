"""Exact rounding and averaging expressions.

Warehouse rounding is decimal and half-away-from-zero. Dividing decimals in
Spark rounds once at scale >= 6 and rounding again would round twice, and
``round`` on a double rounds the shortest decimal string rather than the binary
value. So every rounded ratio here is built from integers:

    round(n / d, s) = sign(n) * floor((2 * |n| * 10^s + d) / (2 * d)) / 10^s

Unrounded means are ``double(sum) / double(count)``. That is one IEEE
division of two exactly representable numbers, so every engine gives the
same bits.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

BIG = DecimalType(38, 0)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def ratio_round(num, den, scale: int, precision: int = 18) -> Column:
    """``round(num / den, scale)`` for integer-valued ``num`` and ``den``.

    Returns DECIMAL(precision, scale); NULL when ``den`` is 0 or NULL.
    """
    num, den = _c(num), _c(den)
    k = 10 ** scale
    mag = F.floor((F.abs(num) * (2 * k) + den) / (den * 2))
    signed = F.when(num < 0, -mag).otherwise(mag)
    step = F.lit(Decimal(1).scaleb(-scale)) if scale > 0 else F.lit(Decimal(1))
    value = (signed.cast(DecimalType(20, 0)) * step).cast(DecimalType(precision, scale))
    return F.when(den != 0, value)


def mean_double(total, count) -> Column:
    """Unrounded mean as ``double(sum) / double(count)``; NULL for count 0."""
    total, count = _c(total), _c(count)
    return F.when(count != 0, total.cast("double") / count.cast("double"))


def scaled_int(col, scale: int) -> Column:
    """Decimal with ``scale`` digits -> exact integer units (value * 10^scale)."""
    return (_c(col) * F.lit(10 ** scale)).cast("long")


def exact_ratio_round(num: Column, den: Column, scale: int, precision: int = 18) -> Column:
    """round(num / den, scale) half away from zero, by exact integer division
    (the terms are beyond double precision). NULL when ``den`` is 0."""
    sign = F.when(den < 0, F.lit(-1)).otherwise(F.lit(1)).cast(BIG)
    n, d = (num.cast(BIG) * sign).cast(BIG), (den.cast(BIG) * sign).cast(BIG)
    mag = (F.abs(n) * F.lit(2 * 10 ** scale).cast(BIG) + d).cast(BIG)
    q = _intdiv(mag, (d * F.lit(2).cast(BIG)).cast(BIG))
    signed = F.when(n < 0, -q).otherwise(q)
    step = F.lit(1).cast(DecimalType(1, 0)) if scale == 0 else \
        F.lit("0." + "0" * (scale - 1) + "1").cast(DecimalType(scale, scale))
    return F.when(d != 0, (signed.cast(DecimalType(20, 0)) * step).cast(DecimalType(precision, scale)))


def _intdiv(a: Column, b: Column) -> Column:
    """floor(a / b) for non-negative DECIMAL(38,0) a and positive b.

    The decimal quotient is rounded at six places, which can only round up
    across an integer, so one correction step makes the floor exact.
    """
    q = F.floor(a / b).cast(BIG)
    return F.when(q * b > a, q - 1).otherwise(q).cast("long")


def mean_fixed(col, scale: int = 6) -> Column:
    """Aggregate: exact mean of a column with at most ``scale`` decimals,
    rounded half away from zero to ``scale`` places (DECIMAL(20, scale)).

    Means of cents or counts can fall exactly on a rounding tie, where a
    double mean would round either way depending on summation order.
    """
    c = _c(col)
    units = (F.sum(c.cast(DecimalType(38, scale))) * F.lit(10 ** scale)).cast(BIG)
    q = exact_ratio_round(units, F.count(c), 0, 38)
    step = F.lit("0." + "0" * (scale - 1) + "1").cast(DecimalType(scale, scale))
    return (q * step).cast(DecimalType(20, scale))
