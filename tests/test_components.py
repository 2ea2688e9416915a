"""Star contraction against union-find, and the join that splits hot keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orderflow.operators import graph
from orderflow.operators.components import components, contract, distinct_edges, hub_keys, split_join


def union_find(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    return {x: top(x) for x in up}


def shapes():
    rng = random.Random(5)
    yield "chain", [(f"c{i:03}", f"c{i + 1:03}") for i in range(30)]
    yield "star", [("s000", f"s{i:03}") for i in range(1, 300)]
    yield "mixed", [(f"m{rng.randrange(60):03}", f"m{rng.randrange(60):03}") for _ in range(45)] * 2
    yield "loops and nulls", [("a", "a"), ("b", None), (None, None), ("d", "c"), ("c", "d")]
    yield "none", []


@pytest.mark.parametrize("name,edges", list(shapes()))
def test_components_equal_union_find(spark, name, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    got = [(r.v, r.component) for r in components(df, hubs=2, least=1).collect()]
    assert len(got) == len(dict(got)) and dict(got) == union_find(edges), name


def test_a_round_shrinks_chains_and_hubs(spark):
    for name, edges in list(shapes())[:2]:
        df = distinct_edges(spark.createDataFrame(edges, "a string, b string"), "a", "b")
        stars, left = contract(df, 0, hubs=2, least=1)
        before, after = stars.count(), stars.select("star").distinct().count()
        assert after <= 3 * before / 4 and left.count() < len(edges), name


@pytest.mark.parametrize("hubs", [[], ["hot"], ["hot", "k1", "k2", "gone"]])
def test_split_join_is_a_left_join(spark, hubs):
    rows = spark.createDataFrame([("hot", i) for i in range(30)] + [(f"k{i % 30}", i) for i in range(90)] + [(None, 7), (None, 8)], "k string, x int")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 30, 2)] + [("other", 5)], "k string, y int")
    got = sorted(map(str, split_join(rows, table, "k", hubs).select("k", "x", "y").collect()))
    assert got == sorted(map(str, rows.join(table, "k", "left").select("k", "x", "y").collect()))


def test_an_address_with_a_third_of_the_orders(spark):
    """The hot address is joined where its rows lie; no task of the shuffled rest is over twice its share."""
    orders = spark.range(200).select(
        F.format_string("o%05d", "id").alias("order_id"), (F.col("id") % 7 == 0).alias("is_fraud"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("ip"), F.col("id").cast("string"))).alias("ip_address"),
        F.concat(F.lit("u"), F.floor(F.col("id") / 5).cast("string")).alias("user_id"))
    rows = orders.collect()
    links, seen = [], {}
    for r in rows:
        for node in ("ip:" + r.ip_address, "user:" + r.user_id):
            links.append((r.order_id, seen.setdefault(node, r.order_id)))
    want = {r.order_id: r.order_id for r in rows} | union_find(links)
    found = graph.connected_components(orders, hubs=4, least=20)
    assert {r.order_id: r.component for r in found.collect()} == want

    inc = graph.incidence(orders)
    total = inc.count()
    centre = inc.groupBy("node").agg(F.min("order_id").alias("first"), F.count("*").alias("__n"))
    hubs = hub_keys(centre, "node", 4, 20)
    assert hubs == ["ip:hot"]
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = split_join(inc, centre.drop("__n"), "node", hubs)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == total and max(sizes) <= 2 * total / len(sizes)


def test_the_planners_estimates_stay_small_round_after_round(spark):
    """The estimated size of a join is the product of its sides'; kept from round to round it grew to thousands of digits."""
    left = distinct_edges(spark.createDataFrame([(f"c{i:03}", f"c{i + 1:03}") for i in range(100)], "a string, b string"), "a", "b")
    for number in range(3):
        stars, left = contract(left, number)
    for df in (stars, left):
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        assert len(str(size)) < 40
    assert sorted(left.columns) == ["a", "b"] and 0 < left.count() < 100
