"""Exact ranks and cumulative sums by value, without a single-partition or
single-key window.

``RANK() OVER (PARTITION BY p ORDER BY v DESC)`` is ``1 + #{rows in p with a
greater v}``, and PR curves, ROC-AUC, KS statistics and quantiles all reduce
to such "sum of weights beyond this value" figures. They are built from
aggregates:

1. sums of weights per distinct (p, v), combined map-side;
2. these rows are range-partitioned by (p, v) on sampled bounds, so ranges hold
   alike many rows however the values are spread: a value held by a third of
   all input rows is one row here, and an outlier moves no bound;
3. totals per (p, range), and a running sum over the ranges that p touches,
   give the weight in earlier ranges;
4. a running sum inside each (p, range) gives the rest.

Every window is bounded by the number of ranges or by one range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.operators.common import join_null_safe
from orderflow.session import cut_lineage


def cumulative_by_value(df: DataFrame, parts: Sequence[str], value: str,
                        weights: Mapping[str, Column] | None = None,
                        descending: bool = True, ranges: int | None = None) -> DataFrame:
    """Per distinct (parts, value): for each weight ``w`` the columns
    ``w_eq`` (sum at this value), ``w_beyond`` (sum strictly before it in the
    given direction) and ``w_total`` (sum over the group); plus ``__bucket``
    (the value range of the row, ordered in the same direction).

    NULL values are left out. The default weight is ``n`` = row count; the
    default number of ranges is ``spark.sql.shuffle.partitions``.
    """
    parts = list(parts)
    weights = dict(weights or {"n": F.lit(1)})
    wnames = list(weights)
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    vc = (df.filter(F.col(value).isNotNull()).groupBy(*parts, value)
          .agg(*[F.sum(c.cast("long")).alias(f"{w}_eq") for w, c in weights.items()])
          .repartitionByRange(n, *parts, order).withColumn("__bucket", F.spark_partition_id()))
    vc = cut_lineage(vc)  # pins the range ids to the written rows; read twice below

    per_range = vc.groupBy(*parts, "__bucket").agg(*[F.sum(f"{w}_eq").alias(f"__{w}_here") for w in wnames])
    group = Window.partitionBy(*parts)
    earlier = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.select(
        *parts, "__bucket",
        *[F.coalesce(F.sum(f"__{w}_here").over(earlier), F.lit(0)).alias(f"__{w}_before") for w in wnames],
        *[F.sum(f"__{w}_here").over(group).alias(f"{w}_total") for w in wnames])
    vc = join_null_safe(vc, per_range, parts + ["__bucket"], "inner")

    inside = Window.partitionBy(*parts, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    for w in wnames:
        vc = vc.withColumn(f"{w}_beyond",
                           F.col(f"__{w}_before") + F.coalesce(F.sum(f"{w}_eq").over(inside), F.lit(0)))
    keep = [*parts, value, "__bucket"]
    for w in wnames:
        keep += [f"{w}_eq", f"{w}_beyond", f"{w}_total"]
    return vc.select(*keep)


def value_counts_beyond(df: DataFrame, parts: Sequence[str], value: str,
                        descending: bool = True) -> DataFrame:
    """Per distinct (parts, value): ``n_equal``, ``n_beyond`` and ``n_group``."""
    c = cumulative_by_value(df, parts, value, None, descending)
    return c.select(*parts, value, F.col("n_eq").alias("n_equal"), F.col("n_beyond"),
                    F.col("n_total").alias("n_group"))


def with_rank(df: DataFrame, parts: Sequence[str], value: str, out_col: str,
              descending: bool = True) -> DataFrame:
    """Attach SQL ``RANK()`` (ties share the lowest rank, gaps after ties)."""
    counts = value_counts_beyond(df, parts, value, descending)
    ranked = counts.select(*parts, value, (F.col("n_beyond") + 1).cast("int").alias(out_col))
    return join_null_safe(df, ranked, list(parts) + [value], "left")


def with_pct_rank_average(df: DataFrame, value: str, out_col: str, default: float = 0.5,
                          parts: Sequence[str] = ()) -> DataFrame:
    """Average-tie rank divided by the count of non-NULL values; NULL -> default.

    Matches pandas ``Series.rank(pct=True)`` followed by ``fillna(default)``.
    The result is ``(2 * n_less + n_equal + 1) / (2 * n)`` as one division.
    """
    return attach_pct_rank(df, value_counts_beyond(df, parts, value, descending=False), value, out_col, default, parts)


def attach_pct_rank(df: DataFrame, counts: DataFrame, value: str, out_col: str, default: float = 0.5,
                    parts: Sequence[str] = ()) -> DataFrame:
    """``with_pct_rank_average`` from counts (ascending) that are there already."""
    pct = ((F.col("n_beyond") * 2 + F.col("n_equal") + 1).cast("double")
           / (F.col("n_group") * 2).cast("double"))
    joined = join_null_safe(df, counts.select(*parts, value, pct.alias(out_col)), list(parts) + [value], "left")
    return joined.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(default)))


def global_position(df: DataFrame, order_cols: Sequence[str], out_col: str = "position",
                    partitions: int | None = None) -> DataFrame:
    """0-based position of every row in ascending ``order_cols`` order (which
    must be unique per row), without a single-partition window.

    Rows are range-partitioned on the full sort key, so even a value shared
    by a third of the rows is split across partitions by the tie key. Each
    range is sorted and numbered in place, and a table of the ranges' sizes
    (one row per range) supplies the offsets.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id of a row is its range in the high bits and its place in the sorted
    # range in the low ones; the checkpoint pins both to the written rows.
    ranged = cut_lineage(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                         .withColumn("__id", F.monotonically_increasing_id()))
    place = F.lit((1 << 33) - 1)
    local = (ranged.withColumn("__pid", F.shiftright("__id", 33)).withColumn("__local", F.col("__id").bitwiseAND(place)))
    sizes = local.groupBy("__pid").agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__size").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One row per partition: a broadcast bounded by the partition count.
    joined = local.join(F.broadcast(offsets.select("__pid", "__offset")), "__pid")
    return joined.withColumn(out_col, F.col("__offset") + F.col("__local")).drop("__id", "__pid", "__local", "__offset")


def with_position(df: DataFrame, value: str, tie_key: str, out_col: str = "position") -> DataFrame:
    """0-based position in ascending (value, tie_key) order."""
    return global_position(df, [value, tie_key], out_col)
