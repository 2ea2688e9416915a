"""Leakage-safe order features on a chronological train/test split.

Statistics (label dictionaries, per-user amount mean and std, the 95th
percentile, past-fraud addresses) are fitted on the train split only and
applied to both splits. Row-wise steps are column expressions; fitted
statistics are aggregates joined back by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from orderflow.functions.scalars import one_row
from orderflow.functions.timeparts import is_late_night_model
from orderflow.operators.common import join_null_safe
from orderflow.session import cut_lineage
from orderflow.operators.ranking import attach_pct_rank, cumulative_by_value, global_position
from orderflow.operators.stats import quantiles_of_counts
from orderflow.operators.velocity import trailing_count

# The model's feature list, in order.
FEATURE_COLS = (
    "order_amount",
    "orders_per_user_last_minute",
    "location_mismatch",
    "device_type_enc",
    "amount_zscore_user",
    "orders_per_user_last_hour",
    "amount_pct_rank",
    "is_new_user",
    "order_hour",
    "is_late_night",
    "fast_checkout",
    "is_high_value",
    "known_fraud_address",
    "velocity_amount_interaction",
    "location_highvalue_risk",
)
# What they are made of.
SOURCE_COLS = ("order_id", "user_id", "order_amount", "order_timestamp", "orders_per_user_1m", "location_mismatch", "device_type",
               "account_age_days", "shipping_address", "checkout_seconds", "is_fraud")
TRAIN_FRACTION = 0.8
NEW_USER_DAYS = 30
HIGH_VALUE_QUANTILE = 0.95
FAST_CHECKOUT_SECONDS = 10
HOUR_US = 3_600_000_000

D6 = DecimalType(20, 6)


def r6(c: Column) -> Column:
    """Fixed six-decimal presentation of a double computed from sums."""
    return F.round(c, 6).cast(D6)


def chrono_split(df: DataFrame, ts_col: str = "order_timestamp", key: str = "order_id",
                 train_fraction: float = TRAIN_FRACTION) -> DataFrame:
    """``split`` = 'train' for the first ``floor(fraction * n)`` rows by (time, key).

    Positions come from an exact global row number over a range partitioning
    (no single-task window, even for a timestamp shared by many rows).
    """
    us = df.withColumn("__us", F.unix_micros(F.col(ts_col)))
    pos = global_position(us, ["__us", key], "__pos")
    n = F.lit(one_row(pos.agg(F.count(F.lit(1)).alias("n"))).n)
    pct = int(round(train_fraction * 100))
    cut = F.floor(n * pct / 100)
    return pos.withColumn("split", F.when(F.col("__pos") < cut, "train").otherwise("test")).drop("__us", "__pos")


def label_dictionary(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(field, label, code): the sorted distinct values of each column, numbered from 0.

    One global position over (field, label) serves all columns, so neither many
    columns nor a high-cardinality one is ordered in one task.
    """
    labels = train.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "field", "label")
    placed = global_position(labels.filter(F.col("label").isNotNull()).distinct(), ["field", "label"], "__at")
    first = placed.groupBy("field").agg(F.min("__at").alias("__first"))
    return placed.join(first, "field").select("field", "label", (F.col("__at") - F.col("__first")).cast("int").alias("code"))


def label_encode(frame: DataFrame, dictionary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds ``<col>_enc``; a value that the dictionary lacks (unseen in train) and NULL are -1."""
    for c in cols:
        codes = dictionary.filter(F.col("field") == c).select(F.col("label").alias(f"__{c}"), F.col("code").alias(f"{c}_enc"))
        frame = frame.join(codes, F.col(c).cast("string") == F.col(f"__{c}"), "left").drop(f"__{c}")
        frame = frame.withColumn(f"{c}_enc", F.coalesce(f"{c}_enc", F.lit(-1)))
    return frame


def user_amount_stats(train: DataFrame, user: str = "user_id", amount: str = "order_amount") -> DataFrame:
    """Per-user sample mean and std of the amount; single-order std -> 1, zero std -> 1."""
    return train.groupBy(user).agg(
        F.avg(F.col(amount).cast("double")).alias("__u_mean"),
        F.coalesce(F.stddev_samp(F.col(amount).cast("double")), F.lit(1.0)).alias("__u_std"),
    ).withColumn("__u_std", F.when(F.col("__u_std") == 0, F.lit(1.0)).otherwise(F.col("__u_std")))


def amount_zscore(frame: DataFrame, stats: DataFrame, mean: float | None, std: float | None,
                  user: str = "user_id", amount: str = "order_amount") -> DataFrame:
    """(amount - user mean) / user std; users unseen in train use the train rows'
    own mean and std; NULL -> 0."""
    j = frame.join(stats, user, "left")
    middle = F.coalesce(F.col("__u_mean"), F.lit(mean).cast("double"))
    width = F.coalesce(F.col("__u_std"), F.lit(std).cast("double"))
    z = (F.col(amount).cast("double") - middle) / F.when(width == 0, F.lit(1.0)).otherwise(width)
    return j.withColumn("amount_zscore_user", F.coalesce(z, F.lit(0.0))).drop("__u_mean", "__u_std")


def train_amount_stats(train: DataFrame, amount: str = "order_amount") -> tuple[float | None, float | None]:
    """Mean and sample deviation (one row: 1) of all train amounts."""
    a = F.col(amount).cast("double")
    row = one_row(train.agg(F.avg(a).alias("mean"), F.coalesce(F.stddev_samp(a), F.lit(1.0)).alias("std")))
    return row.mean, row.std


def pct_rank_of_train(frame: DataFrame, amount: str = "order_amount", out_col: str = "amount_pct_rank_train") -> DataFrame:
    """Percent rank of every row's amount among the train rows' amounts: the share of them that
    is smaller, with half of those that are equal. No split ranks itself."""
    is_train = (F.col("split") == "train").cast("int")
    counts = cumulative_by_value(frame.select("split", amount), [], amount, {"t": is_train}, descending=False)
    rank = (F.col("t_beyond") * 2 + F.col("t_eq")).cast("double") / (F.col("t_total") * 2).cast("double")
    ranked = join_null_safe(frame, counts.select(amount, rank.alias(out_col)), [amount], "left")
    return ranked.withColumn(out_col, F.coalesce(out_col, F.lit(0.5)))


HIGH_VALUE_COLS = frozenset({"is_high_value", "location_highvalue_risk"})


def engineer(tx: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """order_id, split, is_fraud and the columns ``cols`` of the feature matrix.

    Only the statistics that ``cols`` need are fitted. ``tx`` needs: order_id, user_id,
    order_amount, order_timestamp, orders_per_user_1m, location_mismatch,
    device_type, account_age_days, shipping_address, checkout_seconds, is_fraud.
    """
    asked = set(cols)
    # The split frame feeds the statistics; its rows are checkpointed where
    # they are numbered, so none of them runs the upstream pipeline again. Only columns
    # that a feature is made of go along.
    df = chrono_split(tx.select(*SOURCE_COLS))
    train = df.filter(F.col("split") == "train")

    if "device_type_enc" in asked:
        df = label_encode(df, label_dictionary(train, ["device_type"]), ["device_type"])
    if "amount_zscore_user" in asked:
        df = amount_zscore(df, user_amount_stats(train), *train_amount_stats(train))
    if "orders_per_user_last_hour" in asked:
        us = df.withColumn("__us", F.unix_micros("order_timestamp"))
        df = trailing_count(us, ["split", "user_id"], "__us", HOUR_US - 1, "orders_per_user_last_hour").drop("__us")
    p95 = F.lit(None).cast("double")
    if "amount_pct_rank" in asked or asked & HIGH_VALUE_COLS:
        # One table of cumulative counts serves the percent ranks and the exact 95th
        # percentile of the train rows.
        counted = df if "amount_pct_rank" in asked else train
        counts = cumulative_by_value(counted.select("split", "order_amount"), ["split"], "order_amount", descending=False)
        if "amount_pct_rank" in asked:
            beyond = counts.select("split", "order_amount", F.col("n_eq").alias("n_equal"), "n_beyond", F.col("n_total").alias("n_group"))
            df = attach_pct_rank(df, beyond, "order_amount", "amount_pct_rank", parts=["split"])
        if asked & HIGH_VALUE_COLS:
            high = quantiles_of_counts(counts.filter(F.col("split") == "train"), [], "order_amount", [HIGH_VALUE_QUANTILE]).collect()  # one row, or none without train rows
            p95 = F.lit(high[0].quantile if high else None).cast("double")
    if "known_fraud_address" in asked:
        fraud_addresses = train.filter(F.col("is_fraud")).select("shipping_address").distinct().withColumn("__known", F.lit(1))
        df = df.join(fraud_addresses, "shipping_address", "left")

    amount = F.col("order_amount").cast("double")
    hour = F.hour("order_timestamp")
    high_value = (amount > p95).cast("int")
    mismatch = F.col("location_mismatch").cast("int")
    velocity = F.col("orders_per_user_1m").cast("int")
    made = {
        "order_amount": lambda: amount,
        "orders_per_user_last_minute": lambda: velocity,
        "location_mismatch": lambda: mismatch,
        "device_type_enc": lambda: F.col("device_type_enc").cast("int"),
        "amount_zscore_user": lambda: F.col("amount_zscore_user"),
        "orders_per_user_last_hour": lambda: F.col("orders_per_user_last_hour").cast("int"),
        "amount_pct_rank": lambda: F.col("amount_pct_rank"),
        "is_new_user": lambda: (F.col("account_age_days") < NEW_USER_DAYS).cast("int"),
        "order_hour": lambda: hour.cast("int"),
        "is_late_night": lambda: is_late_night_model(hour),
        "fast_checkout": lambda: F.coalesce(F.col("checkout_seconds") < FAST_CHECKOUT_SECONDS, F.lit(False)).cast("int"),
        "is_high_value": lambda: high_value,
        "known_fraud_address": lambda: F.coalesce(F.col("__known"), F.lit(0)).cast("int"),
        "velocity_amount_interaction": lambda: velocity * amount,
        "location_highvalue_risk": lambda: mismatch * high_value,
    }
    return df.select("order_id", "split", F.col("is_fraud").cast("int").alias("is_fraud"), *[made[c]().alias(c) for c in FEATURE_COLS if c in asked])


def rounded(features: DataFrame) -> DataFrame:
    """Feature matrix with the doubles fixed to six decimals (for exchange/compare)."""
    out = []
    for name, dtype in features.dtypes:
        out.append(r6(F.col(name)).alias(name) if dtype == "double" else F.col(name))
    return features.select(*out)


def standardize(features: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    """(x - train mean) / train population std (zero std -> 1), NULL -> 0 first."""
    filled = cut_lineage(features.fillna(0, subset=list(cols)))
    train = filled.filter(F.col("split") == "train")
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    s = one_row(stats)
    out = [F.col("order_id"), F.col("split"), F.col("is_fraud")]
    for c in cols:
        sd = s[f"s_{c}"]
        sd = 1.0 if not sd else sd
        out.append(((F.col(c).cast("double") - F.lit(s[f"m_{c}"])) / F.lit(sd)).alias(c))
    return filled.select(*out)

