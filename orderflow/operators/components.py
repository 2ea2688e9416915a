"""Connected components by star contraction, and a join whose hot keys are no single task.

A round orders all vertices by a hash with the round's number. Every vertex points to the first
of itself and its neighbours, so the graph falls into stars; stars become vertices, and only edges
between different stars go on. In expectation at least a quarter of the vertices goes each
round, whatever the graph, so the edge set shrinks geometrically and long chains take as few rounds as
hubs. The last vertex of a component in a round's order is never the centre of a star, so each
round removes one at least. The steps are then unrolled backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.functions.scalars import one_row
from orderflow.session import cut_estimates

HUBS, HUB_ROWS = 256, 100_000


def hub_keys(counts: DataFrame, key: str, hubs: int = HUBS, least: int = HUB_ROWS) -> list:
    """The ``hubs`` keys with the most rows, of (key, __n), where they have more than ``least``. Any other
    key has at most one in ``hubs`` of the rows, or ``least``."""
    most = counts.filter(F.col(key).isNotNull() & (F.col("__n") > least)).orderBy(F.desc("__n"), key).limit(hubs)
    return [r[0] for r in most.select(key).collect()]


def split_join(rows: DataFrame, table: DataFrame, key: str, hubs: list) -> DataFrame:
    """``rows`` left join ``table`` (one row a key), where a key may hold most of the rows.

    ``hubs`` (a bounded list, see ``hub_keys``) are joined by broadcast, where their rows lie, so that no task
    takes all rows of one. ``rows`` is read twice if there are any.
    """
    if not hubs:
        return rows.join(table, key, "left")
    hot = F.coalesce(F.col(key).isin(hubs), F.lit(False))
    near = rows.filter(hot).join(F.broadcast(table.filter(F.col(key).isin(hubs))), key, "left")
    return near.unionByName(rows.filter(~hot).join(table, key, "left"))


def _counted_join(rows: DataFrame, table: DataFrame, key: str, hubs: int, least: int) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return split_join(rows, table, key, hub_keys(counts, key, hubs, least))


def contract(edges: DataFrame, number: int, hubs: int = HUBS, least: int = HUB_ROWS) -> tuple[DataFrame, DataFrame]:
    """One round: (v, star) for every vertex, and the different (a, b) edges between stars."""
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("w"))
    ways = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
                                          F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*")
    first = ways.groupBy("v").agg(F.min(rank("w")).alias("first"), F.count(F.lit(1)).alias("__n"))
    stars = cut_estimates(first.select("v", F.least("first", rank("v"))["w"].alias("star"), "__n"))
    many = hub_keys(stars, "v", hubs, least)
    moved = edges
    for end in ("a", "b"):
        to = stars.select(F.col("v").alias(end), F.col("star").alias(f"__{end}"))
        moved = split_join(moved, to, end, many).drop(end)
        if many and end == "a":
            moved = cut_estimates(moved)
    return stars.drop("__n"), cut_estimates(distinct_edges(moved, "__a", "__b"))


def distinct_edges(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The different pairs, smaller end first, without loops and nulls.

    They leave through ``explode``: a filter's constraints would stay with the stored rows, and the
    optimizer would combine those of all rounds.
    """
    pair = F.array(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    return rows.select(F.explode(F.when(F.col(a) != F.col(b), pair)).alias("e")).select("e.a", "e.b").distinct()


def components(edges: DataFrame, hubs: int = HUBS, least: int = HUB_ROWS) -> DataFrame:
    """(v, component) for every vertex of an edge (a, b): the component's smallest vertex.

    Edges may repeat, run both ways or be loops; edges with a null end link nothing. A vertex
    that only loops is in no row.
    """
    left = cut_estimates(distinct_edges(edges, "a", "b"))
    steps: list[DataFrame] = []
    while not left.isEmpty():
        stars, left = contract(left, len(steps), hubs, least)
        steps.append(stars)
    if not steps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("component"))
    roots = steps.pop()
    while steps:
        up = roots.select(F.col("v").alias("star"), F.col("star").alias("root"))
        # A star that no edge left is a whole component.
        roots = cut_estimates(_counted_join(steps.pop(), up, "star", hubs, least).select("v", F.coalesce("root", "star").alias("star")))
    smallest = roots.groupBy("star").agg(F.min("v").alias("component"))
    return _counted_join(roots, smallest, "star", hubs, least).select("v", "component")
