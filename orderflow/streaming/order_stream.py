"""The order stream as one Structured Streaming query.

decode -> one ``foreachBatch`` that judges, accepts, scores and writes. What has
to be remembered between batches is in tables of the shared folder, partitioned
by date (or hour), then batch:

* ``clocks``: the processing time that a batch is judged by, written first. A batch that is
  repeated after a failure is judged by the same time, so no decision changes.
* ``accepted``: accepted orders of the last day, users and addresses hashed. An order that repeats
  an accepted one within 24 hours is dropped. Older dates are removed.
* ``processed``: scored orders whose sliding windows are closed (the archive).
* ``open``: scored orders of windows that are still open, written anew by every
  batch with the counts so far; older batches' are removed.
* ``features``: values of each order that live for one hour of event time (``FEATURE_TTL``), in slices
  by the hour in which they expire; expired slices are removed.
* ``rollup``: sums by minute and category of the orders that a batch archived.
* ``dead_letter``: rejected and late orders with the reason.
* ``commits``: one row per batch, written last. Readers see committed batches only, so a
  batch appears in all outputs at once, and a failed one in none. Orders more than a
  minute older than the newest one of earlier commits are late.

An order is in ``processed`` or in ``open``, never in both, so table and archive hold it
once. Its velocity is the larger count of the two 1-minute windows (sliding by 30 s) that
hold it. A batch first clears what an earlier attempt has left and reads only earlier
batches; a committed batch that comes again is skipped. Users and addresses are
hashed before anything is written.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions import rules
from orderflow.functions.scalars import one_row
from orderflow.operators import staging as stg_ops
from orderflow.operators.velocity import attach_sliding_velocity
from orderflow.sources import ingest, sinks

WATERMARK = "1 minute"
WINDOW = "1 minute"
SLIDE = "30 seconds"
LATE_US, SLIDE_US, WINDOW_US = 60_000_000, 30_000_000, 60_000_000
HOUR_US = 3_600_000_000
REPEAT_US = 24 * HOUR_US
FEATURE_TTL = HOUR_US
KEPT_COMMITS = 100
MISSING, LATE = "MISSING_FIELD", "LATE"


def guard(now: Column | None = None) -> Column:
    """Stream guard; ``now`` defaults to the processing clock."""
    return reject_reason(now).isNull()


def reject_reason(now: Column | None = None) -> Column:
    """Why an order can't be processed: the guard's reasons, then a missing required field; else null."""
    missing = F.lit(False)
    for field in ingest.REQUIRED_FIELDS:
        missing = missing | F.col(field).isNull()
    valid = stg_ops.guard_condition(now if now is not None else F.current_timestamp())
    return F.when(~valid, stg_ops.guard_reason()).when(missing, F.lit(MISSING))


def score_struct() -> Column:
    """The scoring step as a struct of native expressions with the same four
    fields the reference's per-row HTTP UDF returned."""
    velocity = F.least(F.col("orders_per_user_1m"), F.lit(10))
    raw = (F.lit(0.05) + F.lit(0.25) * F.col("location_mismatch")
           + F.when(F.col("amount") > rules.HIGH_VALUE_WAREHOUSE, 0.35).otherwise(0.0)
           + F.when(F.hour("timestamp").between(0, 5), 0.10).otherwise(0.0)
           + F.lit(0.03) * velocity)
    score = F.round(F.least(F.lit(1.0), raw), 4)
    return F.struct(
        F.coalesce(rules.is_fraud(score), F.lit(False)).alias("is_fraud"),
        F.coalesce(score, F.lit(0.0)).alias("fraud_score"),
        F.coalesce(rules.risk_level(score), F.lit("ERROR")).alias("risk_level"),
        F.array_join(rules.top_drivers("orders_per_user_1m", "location_mismatch", "amount"), "; ").alias("reasoning"),
    )


def scored(valid_rows: DataFrame) -> DataFrame:
    return valid_rows.withColumn("fraud_res", score_struct()).select("*", "fraud_res.*").drop("fraud_res")


def first_in_a_day(valid: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """Orders that repeat no accepted order of the 24 hours before them.

    Of rows with one id and time one is kept. Times of an id are walked in
    order: a time is accepted a day or more after the last accepted one.
    """
    rest = [c for c in valid.columns if c not in ("order_id", "timestamp")]
    once = (valid.groupBy("order_id", "timestamp").agg(F.max_by(F.struct(*rest), F.xxhash64(*rest)).alias("__r"))
            .select("order_id", "timestamp", "__r.*").select(*valid.columns))
    times = once.groupBy("order_id").agg(F.array_sort(F.collect_list(F.unix_micros("timestamp"))).alias("times"))
    if accepted is None:
        times = times.withColumn("last", F.lit(None).cast("long"))
    else:
        last = accepted.groupBy("order_id").agg(F.max(F.unix_micros("timestamp")).alias("last"))
        times = times.join(last, "order_id", "left")
    before = F.when(F.col("last").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("last"))
    far = lambda acc, t: F.when((F.size(acc) == 0) | (t >= F.try_element_at(acc, F.lit(-1)) + REPEAT_US), F.concat(acc, F.array(t))).otherwise(acc)
    taken = F.aggregate("times", before, far)
    taken = F.filter(taken, lambda t: F.col("last").isNull() | (t != F.col("last")))
    kept = times.select("order_id", F.explode(taken).alias("__us"))
    return (once.withColumn("__us", F.unix_micros("timestamp")).join(kept, ["order_id", "__us"], "left_semi").drop("__us"))


@dataclass
class StreamOutputs:
    root: str

    def __post_init__(self):
        for name in ("clocks", "accepted", "processed", "open", "features", "rollup", "dead_letter", "commits"):
            setattr(self, name, os.path.join(self.root, name))

    def last_commit(self, spark: SparkSession, before: int | None = None):
        """(batch_id, newest_us) of the last committed batch (before a batch), or None."""
        where = F.lit(True) if before is None else F.col("batch_id") < before
        rows = sinks.read_table_or_none(spark, self.commits, where)
        return None if rows is None else rows.orderBy(F.desc("batch_id")).first()

    def _committed(self, spark: SparkSession, path: str) -> DataFrame | None:
        last = self.last_commit(spark)
        return None if last is None else sinks.read_table_or_none(spark, path, F.col("batch_id") <= last.batch_id)

    def _open_rows(self, spark: SparkSession) -> DataFrame:
        last = self.last_commit(spark)
        return sinks.read_table(spark, self.open).filter(F.col("batch_id") == (-1 if last is None else last.batch_id))

    def archive_rows(self, spark: SparkSession) -> DataFrame:
        """Scored orders of closed windows, by order_date and batch_id."""
        closed = self._committed(spark, self.processed)
        return closed if closed is not None else self._open_rows(spark).limit(0)

    def table_rows(self, spark: SparkSession) -> DataFrame:
        """The operational table: every accepted order once."""
        return self.archive_rows(spark).unionByName(self._open_rows(spark))

    def live_features(self, spark: SparkSession, at_us: int | None = None) -> DataFrame:
        """Values that live at an event time (the newest, if none is given), the latest of each order:
        order_id, user_id, velocity_1m, fraud_score, expires_at."""
        last = self.last_commit(spark)
        at = at_us if at_us is not None else (last.newest_us if last is not None else None)
        rows = sinks.read_table(spark, self.features).filter(F.col("batch_id") <= (-1 if last is None else last.batch_id))
        live = rows.filter((F.col("expires_hour") >= F.lit(at) / HOUR_US - 1) & (F.unix_micros("expires_at") > F.lit(at)) & (F.unix_micros("expires_at") <= F.lit(at) + FEATURE_TTL))
        value = F.struct("user_id", "velocity_1m", "fraud_score", "expires_at")
        return live.groupBy("order_id").agg(F.max_by(value, "batch_id").alias("r")).select("order_id", "r.*")

    def minute_sums(self, spark: SparkSession, since: Column | None = None) -> DataFrame:
        """The dashboards' sums by order_date, minute and category, without a scan of the orders: the
        committed rollup (of dates from ``since`` on) and the few orders still open."""
        parts, still_open = self._committed(spark, self.rollup), minute_sums(self._open_rows(spark))
        both = still_open if parts is None else parts.drop("batch_id").unionByName(still_open)
        if since is not None:
            both = both.filter(F.col("order_date") >= F.to_date(since))
        return both.groupBy("order_date", "minute", "category").agg(*[F.sum(c).alias(c) for c in SUMS])

    def dead_rows(self, spark: SparkSession) -> DataFrame:
        dead = self._committed(spark, self.dead_letter)
        if dead is not None:
            return dead
        none = ingest.decode_orders(spark.createDataFrame([], "value string")).withColumn("reject_reason", F.lit(None).cast("string"))
        return none.withColumns({"order_date": F.to_date("timestamp"), "batch_id": F.lit(None).cast("long")})


SUMS = ("orders", "revenue", "fraud_orders", "fraud_revenue", "critical_orders")


def minute_sums(scored_rows: DataFrame) -> DataFrame:
    """Sums of scored orders by order_date, minute and category; amounts are summed as cents."""
    cents = F.round(F.col("amount").cast("double") * 100).cast("long")
    fraud = F.col("is_fraud").cast("int")
    return scored_rows.groupBy("order_date", F.date_trunc("minute", "timestamp").alias("minute"), "category").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(cents).alias("revenue"), F.sum(fraud).cast("long").alias("fraud_orders"),
        F.sum(cents * fraud).alias("fraud_revenue"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_orders"))


def window_end_us() -> Column:
    """When the last window that holds an order ends (epoch microseconds)."""
    return (F.floor(F.unix_micros("timestamp") / F.lit(SLIDE_US)) + 2) * SLIDE_US


def batch_clock(spark: SparkSession, out: StreamOutputs, batch_id: int, now: Column | None) -> Column:
    """The time that the batch is judged by: of its first attempt, if there was one."""
    stored = sinks.read_table_or_none(spark, out.clocks, F.col("batch_id") == batch_id)
    row = stored.first() if stored is not None else None
    if row is None:
        us = one_row(spark.range(1).select(F.unix_micros((now if now is not None else F.current_timestamp()).cast("timestamp")).alias("us"))).us
        sinks.write_partitions(spark.range(1).select(F.lit(us).alias("now_us")), out.clocks, batch_id, by=())
    else:
        us = row.now_us
    return F.timestamp_micros(F.lit(us))


def process_batch(batch: DataFrame, batch_id: int, out: StreamOutputs, now: Column | None = None, key: str | None = None) -> None:
    """One micro-batch: judge, accept, score, write, commit. Without ``key`` the session has to name one."""
    spark = batch.sparkSession
    last = out.last_commit(spark)
    if last is not None and last.batch_id >= batch_id:
        return
    clock = batch_clock(spark, out, batch_id, now)
    for path in (out.accepted, out.processed, out.open, out.features, out.rollup, out.dead_letter):
        sinks.clear_batch(spark, path, batch_id)
    newest = last.newest_us if last is not None else None
    mark = None if newest is None else newest - LATE_US
    batch = batch.persist()         # read once from the source; lost blocks are read again
    try:
        reason = reject_reason(clock)
        if mark is not None:
            reason = F.coalesce(reason, F.when(F.unix_micros("timestamp") < mark, F.lit(LATE)))
        judged = stg_ops.mask_pii(batch.withColumn("reject_reason", reason), key)
        dead = judged.filter(F.col("reject_reason").isNotNull())
        sinks.write_partitions(dead.withColumn("order_date", F.to_date("timestamp")), out.dead_letter, batch_id)

        valid = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
        known = None
        if mark is not None:
            since = F.timestamp_micros(F.lit(mark - REPEAT_US))
            known = sinks.read_table_or_none(spark, out.accepted, (F.col("batch_id") < batch_id) & (F.col("order_date") >= F.to_date(since)) & (F.col("timestamp") >= since))
        accepted = first_in_a_day(valid, known).withColumn("order_date", F.to_date("timestamp"))
        sinks.write_partitions(accepted, out.accepted, batch_id)
        here = one_row(valid.agg(F.max(F.unix_micros("timestamp")).alias("us"))).us
    finally:
        batch.unpersist()
    newest = max((x for x in (newest, here) if x is not None), default=None)
    rows = sinks.read_table_or_none(spark, out.accepted, F.col("batch_id") <= batch_id)
    if newest is not None and rows is not None:
        write_scores(rows, batch_id, out, mark, newest)
    sinks.write_partitions(spark.range(1).select(F.lit(newest).cast("long").alias("newest_us")), out.commits, batch_id, by=())
    forget(spark, out, batch_id, newest)


def write_scores(rows: DataFrame, batch_id: int, out: StreamOutputs, mark: int | None, newest: int) -> None:
    """Score the orders whose last window has closed since the batch before, and those still open."""
    if mark is not None:
        since = F.timestamp_micros(F.lit(mark - 2 * WINDOW_US))
        rows = rows.filter((F.col("order_date") >= F.to_date(since)) & (F.col("timestamp") >= since))
    counted = scored(attach_sliding_velocity(rows.drop("batch_id")))
    if mark is not None:
        counted = counted.filter(window_end_us() > mark)
    closed = window_end_us() <= newest - LATE_US
    sinks.write_partitions(counted.filter(closed), out.processed, batch_id)
    sinks.write_partitions(counted.filter(~closed), out.open, batch_id, by=())
    sinks.write_partitions(minute_sums(counted.filter(closed)), out.rollup, batch_id)
    expires = F.unix_micros("timestamp") + FEATURE_TTL
    values = counted.filter(expires > newest).select(
        "order_id", "user_id", F.col("orders_per_user_1m").alias("velocity_1m"), "fraud_score",
        F.timestamp_micros(expires).alias("expires_at"), F.floor(expires / F.lit(HOUR_US)).alias("expires_hour"))
    sinks.write_partitions(values, out.features, batch_id, by=("expires_hour",))


def forget(spark: SparkSession, out: StreamOutputs, batch_id: int, newest: int | None) -> None:
    """Remove what no later batch and no reader needs; what a failure leaves here goes with the next batch.

    The open orders and the commit before the last stay for readers that have begun."""
    for path, kept in ((out.open, 1), (out.clocks, 1), (out.commits, KEPT_COMMITS)):
        sinks.expire(spark, path, "batch_id", lambda b: int(b) < batch_id - kept)
    if newest is None:
        return
    day = str(one_row(spark.range(1).select(F.to_date(F.timestamp_micros(F.lit(newest - LATE_US - REPEAT_US))).cast("string").alias("d"))).d)
    sinks.expire(spark, out.accepted, "order_date", lambda d: d < day)
    sinks.expire(spark, out.features, "expires_hour", lambda h: (int(h) + 1) * HOUR_US <= newest)


def run_available(spark: SparkSession, source_path: str, root: str, now: Column | None = None,
                  max_files_per_trigger: int | None = None, key: str | None = None) -> StreamOutputs:
    """Process everything currently in ``source_path`` and stop (replays, tests).

    Restarting with the same ``root`` resumes from its checkpoint: files
    already processed are not read again.
    """
    out = StreamOutputs(root)
    decoded = ingest.decode_orders(ingest.file_order_stream(spark, source_path, max_files_per_trigger))
    q = (decoded.writeStream
         .option("checkpointLocation", os.path.join(root, "_checkpoint"))
         .foreachBatch(lambda batch, batch_id: process_batch(batch, batch_id, out, now, key))
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return out


def sliding_counts_stream(decoded: DataFrame) -> DataFrame:
    """The velocity aggregate alone (append mode, closed windows only)."""
    return (decoded.withWatermark("timestamp", WATERMARK)
            .groupBy(F.window("timestamp", WINDOW, SLIDE).alias("window"), "user_id")
            .agg(F.count(F.lit(1)).alias("orders_per_user_1m"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "user_id", "orders_per_user_1m"))


def run_sliding_counts(spark: SparkSession, source_path: str, root: str) -> DataFrame:
    """Run the velocity aggregate over the available files; return the closed windows."""
    decoded = ingest.decode_orders(ingest.file_order_stream(spark, source_path))
    counts = sliding_counts_stream(decoded.filter(guard()))
    path = os.path.join(root, "sliding")
    q = (counts.writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", os.path.join(root, "_ckpt_sliding"))
         .trigger(availableNow=True).start(path))
    q.awaitTermination()
    return spark.read.parquet(path)
