"""Per-key trailing counts over event time without one partition per key.

A window partitioned by user alone puts a hot user (a bot, or the NULL-user
bucket) in one task. Here the frame ``(t - span, t]`` (``span = width + 1``)
is cut into ``m`` sub-buckets of width ``B = span / m``, and the window is
partitioned by (key, sub-bucket):

* rows of the query's own sub-bucket: a running count inside (key, bucket);
* the ``m - 1`` sub-buckets fully inside the frame: their totals, from a
  per-(key, bucket) aggregate whose rows are sent as *summary* rows to the
  ``m - 1`` buckets they serve, in the same window input (no join, no window
  over a key);
* the sub-bucket ``m`` back, cut by the frame start: every row is also sent,
  as a *marker* ``s = t + span``, to the bucket ``m`` ahead, where it counts
  for a query ``t`` exactly when ``s > t``.

That is 2N rows plus a small aggregate, no pairs, and the result equals
``count(*) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN width PRECEDING AND
CURRENT ROW)`` (ties included, as a RANGE frame includes peers). A task holds
one key's rows within ``B``, not its whole history.

By default ``m`` is 1: there are no summary rows, so the input is read once,
and a task holds a key's rows of two frames. That is right for frames of a
minute. Long frames (the 24-hour block list) pass a larger ``m`` and pay for
the second read of the input with smaller tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_KIND = "__tc_kind"
_BUCKET = "__tc_bucket"
_SORT = "__tc_sort"
_W = "__tc_w"
DEFAULT_SUB_BUCKETS = 1


def _sub_buckets(span: int, wanted: int) -> int:
    for m in range(min(wanted, span), 0, -1):
        if span % m == 0:
            return m
    return 1


def trailing_count(df: DataFrame, keys: Sequence[str], t_col: str, width: int,
                   out_col: str, weight: str | None = None, strict: bool = False,
                   sub_buckets: int = DEFAULT_SUB_BUCKETS) -> DataFrame:
    """Add ``out_col`` = rows with the same ``keys`` and ``t`` in ``[t - width, t]``.

    ``t_col`` must be an integral column (for example epoch microseconds).
    With ``weight`` the rows' weights are summed instead of counted; with
    ``strict`` the frame is ``[t - width, t)`` (earlier rows only).
    """
    keys = list(keys)
    span = width + 1
    m = _sub_buckets(span, sub_buckets)
    size = span // m
    t = F.col(t_col).cast("long")
    payload = [c for c in df.columns if c not in keys]
    df = df.withColumn(_W, F.col(weight).cast("long") if weight else F.lit(1).cast("long"))
    data = df.withColumn(_BUCKET, F.floor(t / F.lit(size)))
    # Data rows and markers come from one scan: each row is exploded into
    # itself (kind 0) and its marker (kind 1, payload nulled, bucket + m).
    kinds = F.when(t.isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    both = data.withColumn(_KIND, F.explode(kinds))
    is_data = F.col(_KIND) == 0
    both = both.select(
        *keys, F.col(_W), F.col(_KIND),
        F.when(is_data, F.col(_BUCKET)).otherwise(F.col(_BUCKET) + m).alias(_BUCKET),
        F.when(is_data, t).otherwise(t + F.lit(span)).alias(_SORT),
        *[F.when(is_data, F.col(c)).alias(c) for c in payload])
    if m > 1:
        # Bucket totals (map-side combined), each sent to the m - 1 later
        # buckets whose frames cover it completely.
        summary = (data.filter(F.col(_BUCKET).isNotNull())
                       .groupBy(*keys, _BUCKET).agg(F.sum(_W).alias(_W))
                       .select(*keys, _W, F.lit(2).alias(_KIND), F.lit(None).cast("long").alias(_SORT),
                               F.explode(F.sequence(F.col(_BUCKET) + 1, F.col(_BUCKET) + m - 1)).alias(_BUCKET)))
        both = both.unionByName(summary, allowMissingColumns=True)

    part = Window.partitionBy(*keys, _BUCKET)
    ordered = part.orderBy(_SORT)
    own = F.when(F.col(_KIND) == 0, F.col(_W)).otherwise(0)
    mark = F.when(F.col(_KIND) == 1, F.col(_W)).otherwise(0)
    full = F.when(F.col(_KIND) == 2, F.col(_W)).otherwise(0)
    upper = -1 if strict else Window.currentRow
    own_upto = F.coalesce(F.sum(own).over(ordered.rangeBetween(Window.unboundedPreceding, upper)), F.lit(0))
    mark_upto = F.coalesce(
        F.sum(mark).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    mark_total = F.sum(mark).over(part)
    full_total = F.sum(full).over(part)
    counted = (both.withColumn(out_col, own_upto + mark_total - mark_upto + full_total)
                   .filter(F.col(_KIND) == 0))
    return counted.drop(_KIND, _BUCKET, _SORT, _W)


def sliding_window_counts(df: DataFrame, key: str, ts_col: str,
                          length: str = "1 minute", slide: str = "30 seconds",
                          out_col: str = "orders_per_user_1m") -> DataFrame:
    """Count per (sliding window, key): the stream's velocity aggregate.

    A plain grouped aggregate: partial counts are combined map-side, so a hot
    key costs one row per window in the shuffle.
    """
    return (df.groupBy(F.window(ts_col, length, slide).alias("window"), F.col(key))
              .agg(F.count(F.lit(1)).cast("int").alias(out_col))
              .select(F.col("window.start").alias("window_start"),
                      F.col("window.end").alias("window_end"), key, out_col))


def attach_sliding_velocity(orders: DataFrame, key: str = "user_id", ts_col: str = "timestamp",
                            slide_seconds: int = 30, out_col: str = "orders_per_user_1m") -> DataFrame:
    """Left-join each order to the sliding windows that contain it.

    With a 1-minute length and 30-second slide an order lies in two windows;
    the order keeps the larger count, so ``order_id`` stays unique. Counts
    are built per (key, 30-second slice): window(start = slice j) = n[j] + n[j+1].
    The lag/lead runs on that aggregate, whose size per key is bounded by the
    number of slices in the time span, not by the number of orders.
    """
    slice_us = slide_seconds * 1_000_000
    sl = F.floor(F.unix_micros(F.col(ts_col)) / F.lit(slice_us))
    per_slice = (orders.filter(F.col(ts_col).isNotNull())
                 .groupBy(F.col(key), sl.alias("__slice"))
                 .agg(F.count(F.lit(1)).alias("__n")))
    w = Window.partitionBy(key).orderBy("__slice")
    prev_n = F.when(F.lag("__slice", 1).over(w) == F.col("__slice") - 1, F.lag("__n", 1).over(w)).otherwise(0)
    next_n = F.when(F.lead("__slice", 1).over(w) == F.col("__slice") + 1, F.lead("__n", 1).over(w)).otherwise(0)
    best = per_slice.select(key, "__slice",
                            F.greatest(prev_n + F.col("__n"), F.col("__n") + next_n).cast("int").alias(out_col))
    keyed = orders.withColumn("__slice", sl)
    joined = keyed.join(best, on=[key, "__slice"], how="left")
    return joined.drop("__slice").fillna(0, subset=[out_col])
