"""The order stream over JSON-lines files: repeats, late and incomplete orders,
repeated batches, several batches against one, restart."""

from __future__ import annotations

import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from orderflow.operators.velocity import attach_sliding_velocity
from orderflow.plans.context import OrderContext
from orderflow.sources import ingest
from orderflow.streaming import order_stream

from conftest import SF_SMALL

NOON = dt.datetime(2024, 3, 1, 12)


def order(order_id="A", at=0.0, user="u1", **change):
    """A wire-format order ``at`` minutes after noon."""
    row = {"order_id": order_id, "user_id": user, "product_id": "P", "product_name": "thing", "category": "c", "amount": 20.0, "quantity": 1,
           "payment_method": "UPI", "ip_address": "10.0.0.1", "device_type": "mobile", "location_mismatch": 0,
           "timestamp": (NOON + dt.timedelta(minutes=at)).isoformat(timespec="microseconds")}
    return {k: v for k, v in (row | change).items() if v is not None}


class Replay:
    """Feeds batches, one file each, to the stream of one folder."""

    def __init__(self, spark, folder):
        self.spark, self.source, self.root, self.n = spark, folder / "in", folder / "out", 0
        os.makedirs(self.source)

    def feed(self, *orders):
        (self.source / f"{self.n:04}.json").write_text("".join(json.dumps(o) + "\n" for o in orders))
        self.n += 1
        return order_stream.run_available(self.spark, str(self.source), str(self.root), max_files_per_trigger=1)

    def table(self):
        out = order_stream.StreamOutputs(str(self.root))
        return sorted((r.order_id, round((r.timestamp - NOON).total_seconds() / 60, 2), r.orders_per_user_1m) for r in out.table_rows(self.spark).collect())

    def dead(self):
        out = order_stream.StreamOutputs(str(self.root))
        return sorted((r.order_id or "", r.reject_reason) for r in out.dead_rows(self.spark).collect())


@pytest.fixture
def replay(spark, tmp_path):
    return Replay(spark, tmp_path)


def test_repeats_within_24_hours_are_dropped(replay):
    replay.feed(order("A"), order("A"), order("A", 0.1))
    replay.feed(order("B", 5))
    replay.feed(order("A", 6), order("C", 7))
    assert replay.table() == [("A", 0, 1), ("B", 5, 1), ("C", 7, 1)]
    replay.feed(order("A", 25 * 60), order("A", 25 * 60 + 1))
    assert replay.table() == [("A", 0, 1), ("A", 1500, 1), ("B", 5, 1), ("C", 7, 1)]


def test_late_and_incomplete_orders_reach_the_dead_letter(replay):
    replay.feed(order("A", 60))
    replay.feed(order("L", 0), order("B", 59.5), order("M", 61, category=None), order("N", 61, user=None), order("X", 61, amount=-1.0),
                order("T", 61, timestamp="soon"), order(None, 61))
    assert replay.dead() == [("", "MISSING_FIELD"), ("L", "LATE"), ("M", "MISSING_FIELD"), ("N", "NULL_USER"), ("T", "NULL_OR_FUTURE_TIMESTAMP"), ("X", "NULL_OR_BAD_AMOUNT")]
    assert [r[0] for r in replay.table()] == ["A", "B"]


def test_no_clear_user_or_address_is_written(replay, spark):
    out = replay.feed(order("A"), order("X", amount=-1.0))
    for rows in (out.table_rows(spark), out.dead_rows(spark)):
        for r in rows.collect():
            assert len(r.user_id) == 64 and len(r.ip_address) == 64 and "u1" not in r.user_id


def test_a_repeated_batch_changes_nothing(replay, spark):
    replay.feed(order("A"), order("B", 0.2))
    out = replay.feed(order("C", 3), order("A", 3.1), order("L", -30))
    before = replay.table(), replay.dead()
    batch = ingest.decode_orders(spark.read.text(str(replay.source / "0001.json")))
    order_stream.process_batch(batch, 1, out)
    order_stream.process_batch(batch, 1, out)
    assert (replay.table(), replay.dead()) == before
    replay.feed(order("D", 9))
    assert [r[0] for r in replay.table()] == ["A", "B", "C", "D"]


def test_several_batches_equal_one(replay, spark, tmp_path):
    rows = [order(f"o{i}", i * 0.13, user=f"u{i % 3}") for i in range(60)]
    for a in range(0, 60, 13):
        replay.feed(*rows[a : a + 13])
    os.makedirs(tmp_path / "one")
    alone = Replay(spark, tmp_path / "one")
    alone.feed(*rows)
    assert replay.table() == alone.table()
    decoded = ingest.decode_orders(spark.read.text(str(alone.source)))
    batch = attach_sliding_velocity(decoded.select("order_id", "user_id", "timestamp"))
    assert sorted((r.order_id, r.orders_per_user_1m) for r in batch.collect()) == [(i, n) for i, _, n in alone.table()]
    out = order_stream.StreamOutputs(str(replay.root))
    archive = {r.order_id for r in out.archive_rows(spark).collect()}
    still_open = {r.order_id for r in out._open_rows(spark).collect()}
    assert not archive & still_open and archive | still_open == {r["order_id"] for r in rows}


def test_date_filter_reads_only_its_folders(replay, spark):
    replay.feed(order("A"), order("B", 24 * 60 + 30), order("C", 3 * 24 * 60))
    out = replay.feed(order("D", 4 * 24 * 60))
    rows = out.archive_rows(spark).filter(F.col("order_date") == F.to_date(F.lit("2024-03-02")))
    assert re.search(r"PartitionFilters: \[[^\]]*isnotnull\(order_date", rows._jdf.queryExecution().executedPlan().toString())
    assert [r.order_id for r in rows.collect()] == ["B"]


def test_readers_see_committed_batches_only(replay, spark, monkeypatch):
    """A crash between any two writes shows nothing; the repeated batch, judged by its first clock, shows all."""
    replay.feed(order("A"), order("B", 0.2))
    out = order_stream.StreamOutputs(str(replay.root))
    rows = [order("C", 3), order("F", 60 * 24 * 365 * 20), order("D", 3.2, category=None)]
    (replay.source / "0001.json").write_text("".join(json.dumps(o) + "\n" for o in rows))
    batch = ingest.decode_orders(spark.read.text(str(replay.source / "0001.json")))
    write, first = order_stream.sinks.write_partitions, F.lit((NOON + dt.timedelta(hours=1)).isoformat()).cast("timestamp")
    before = replay.table(), replay.dead(), sorted(map(tuple, out.minute_sums(spark).collect()))
    for stop in ("dead_letter", "accepted", "processed", "open", "rollup", "features", "commits"):
        def fail(df, path, batch_id, by=("order_date",), stop=stop):
            if path.endswith(stop):
                raise OSError(stop)
            write(df, path, batch_id, by)
        monkeypatch.setattr(order_stream.sinks, "write_partitions", fail)
        with pytest.raises(OSError):
            order_stream.process_batch(batch, 1, out, first)
        assert (replay.table(), replay.dead(), sorted(map(tuple, out.minute_sums(spark).collect()))) == before
    monkeypatch.setattr(order_stream.sinks, "write_partitions", write)
    later = F.lit((NOON + dt.timedelta(days=365 * 30)).isoformat()).cast("timestamp")
    order_stream.process_batch(batch, 1, out, later)
    assert [r[0] for r in replay.table()] == ["A", "B", "C"]
    assert replay.dead() == [("D", "MISSING_FIELD"), ("F", "NULL_OR_FUTURE_TIMESTAMP")]


def test_values_expire_after_an_hour_of_event_time(replay, spark):
    replay.feed(order("A"), order("B", 0.2, user="u2"))
    out = replay.feed(order("C", 30), order("D", 30.1), order("E", 59))
    live = lambda **k: sorted((r.order_id, r.velocity_1m) for r in out.live_features(spark, **k).collect())
    assert live() == [("A", 1), ("B", 1), ("C", 2), ("D", 2), ("E", 1)]
    replay.feed(order("G", 60.1))
    assert live() == [("B", 1), ("C", 2), ("D", 2), ("E", 1), ("G", 1)]
    replay.feed(order("H", 60 * 5))
    assert live() == [("H", 1)]
    # and the slices are gone from disk
    assert {r.order_id for r in spark.read.parquet(out.features).collect()} == {"H"}


def test_live_values_equal_the_batch_form(replay, spark):
    rows = [order(f"o{i}", i * 1.7, user=f"u{i % 3}") for i in range(60)]
    for a in range(0, 60, 17):
        out = replay.feed(*rows[a : a + 17])
    newest = max(r[1] for r in replay.table())
    assert sorted((r.order_id, r.velocity_1m) for r in out.live_features(spark).collect()) == sorted((i, n) for i, t, n in replay.table() if t + 60 > newest)


def test_old_days_and_clear_values_leave_the_disk(replay, spark):
    replay.feed(order("A"), order("B", 1))
    replay.feed(order("C", 60 * 30))
    out = replay.feed(order("D", 60 * 80))
    held = spark.read.parquet(out.accepted).collect()
    assert {r.order_id for r in held} == {"D"} and all(len(r.user_id) == len(r.ip_address) == 64 for r in held)
    assert [r[0] for r in replay.table()] == ["A", "B", "C", "D"]
    assert len([f for f in os.listdir(out.open) if f.startswith("batch_id")]) <= 2
    written = [f for folder, _, names in os.walk(replay.root) for f in (os.path.join(folder, n) for n in names if n.endswith(".parquet"))]
    assert written and not any(b"10.0.0.1" in open(f, "rb").read() for f in written)


def test_rollup_equals_a_scan_after_late_batches(replay, spark):
    rows = [order(f"o{i}", i * 0.4, category=f"c{i % 2}", amount=10.0 + 300 * (i % 5)) for i in range(50)]
    for a, b in ((0, 20), (20, 35), (35, 50)):
        out = replay.feed(*rows[a:b], *([order("late", -60), rows[0]] if a else []))
    full = order_stream.minute_sums(out.table_rows(spark))
    key = lambda df: sorted(tuple(r[c] for c in ("order_date", "minute", "category", *order_stream.SUMS)) for r in df.collect())
    assert key(out.minute_sums(spark)) == key(full) and full.agg(F.sum("orders")).first()[0] == 50
    plan = out.minute_sums(spark, F.lit("2024-03-02").cast("timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*isnotnull\(order_date", plan)
    assert out.minute_sums(spark, F.lit("2024-03-02").cast("timestamp")).count() == 0


def test_hash_key_is_needed_on_a_cluster(spark, monkeypatch):
    from orderflow.operators import staging
    assert staging.hash_key(spark) == staging.USER_HASH_KEY

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: {"set": "x"}.get(key, default))

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="not set"):
        staging.hash_key(Cluster)


def test_fixture_replay_and_restart(spark, tmp_path):
    raw = OrderContext(spark, SF_SMALL).raw
    src, root = str(tmp_path / "source"), str(tmp_path / "root")
    ingest.encode_orders(raw).write.text(src)
    out = order_stream.run_available(spark, src, root)
    decoded = ingest.decode_orders(ingest.encode_orders(raw))
    valid = decoded.filter(order_stream.guard()).select("order_id").distinct().count()
    assert out.table_rows(spark).count() == out.table_rows(spark).select("order_id").distinct().count() == valid
    assert out.dead_rows(spark).count() == decoded.filter(~order_stream.guard()).count()
    order_stream.run_available(spark, src, root)
    assert out.table_rows(spark).count() == valid
