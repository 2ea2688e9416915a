"""The stored table: touched partitions only, all at once, and nothing of a failed run."""

from __future__ import annotations

import os

import pytest

from orderflow.sources import stored


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, day string, v int, at int").selectExpr("k", "CAST(day AS DATE) AS day", "v", "at")


def content(table, spark):
    return sorted((r.k, str(r.day), r.v) for r in table.read(spark).collect())


@pytest.fixture
def table(tmp_path):
    return stored.StoredTable(str(tmp_path / "t"), ("k", "day"), "at", "day")


def files(table):
    return {os.path.join(d, f) for d, _, names in os.walk(table.path) for f in names if f.endswith(".parquet") and "/data/" in d + "/"}


def test_one_changed_key_rewrites_one_partition(spark, table):
    assert table.read(spark) is None
    table.merge(rows(spark, ("a", "2024-01-01", 1, 1), ("b", "2024-01-01", 2, 1), ("c", "2024-01-02", 3, 1)))
    before = files(table)
    assert table.merge(rows(spark, ("a", "2024-01-01", 9, 2))) == ["2024-01-01"]
    assert content(table, spark) == [("a", "2024-01-01", 9), ("b", "2024-01-01", 2), ("c", "2024-01-02", 3)]
    assert {f.split("/data/")[1].split("/")[0] for f in files(table) - before} == {"day=2024-01-01"}
    assert [r.k for r in table.read(spark, lambda part: part > "2024-01-01").collect()] == ["c"]


def test_the_greatest_order_wins_and_ties_go_to_the_incoming_row(spark, table):
    table.merge(rows(spark, ("a", "2024-01-01", 1, 5), ("b", "2024-01-01", 1, 5)))
    table.merge(rows(spark, ("a", "2024-01-01", 2, 4), ("b", "2024-01-01", 2, 5)))
    assert content(table, spark) == [("a", "2024-01-01", 1), ("b", "2024-01-01", 2)]


def test_a_failed_run_leaves_the_old_table(spark, table, monkeypatch):
    table.merge(rows(spark, ("a", "2024-01-01", 1, 1), ("c", "2024-01-02", 3, 1)))
    before, create = content(table, spark), type(spark).createDataFrame

    def fail(self, data, schema=None, *a, **k):
        if schema == "part string, part_version long":
            raise OSError("no manifest")
        return create(self, data, schema, *a, **k)

    incoming = rows(spark, ("a", "2024-01-01", 7, 2), ("d", "2024-01-03", 4, 2))
    monkeypatch.setattr(type(spark), "createDataFrame", fail)
    with pytest.raises(OSError):
        table.merge(incoming)
    monkeypatch.undo()
    assert content(table, spark) == before
    table.merge(rows(spark, ("a", "2024-01-01", 8, 2)))
    assert content(table, spark) == [("a", "2024-01-01", 8), ("c", "2024-01-02", 3)]
    assert table.merge(rows(spark).limit(0)) == []


def test_old_versions_are_removed(spark, table):
    for n in range(5):
        table.merge(rows(spark, ("a", "2024-01-01", n, n)))
    assert len(os.listdir(os.path.join(table.path, "data", "day=2024-01-01"))) <= 3
    assert content(table, spark) == [("a", "2024-01-01", 4)]
