"""Order graph: orders linked when they share an IP (other than 'unknown')
or a user. Pairwise edges are never built.

* The graph is kept as order -> attribute incidence rows (``ip:<x>``,
  ``user:<y>``): linear in the orders, while the clique expansion it stands
  for is quadratic in the largest group.
* Neighbour sums and degrees come from group sums by inclusion-exclusion:
  N(o) = N_ip(o) + N_user(o) - N_ip_and_user(o), each minus the order itself.
  So a GraphSAGE-style mean over neighbours is exact, and a hub IP costs one
  aggregate row.
* Connected components: every attribute becomes a star around its smallest
  order, then ``components`` contracts stars until no edge is left. The edge
  set shrinks every round, and a hub is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.scalars import one_row
from orderflow.operators.common import join_null_safe
from orderflow.operators.components import HUB_ROWS, HUBS, components, hub_keys, split_join
from orderflow.session import cut_lineage

UNKNOWN_IP = "unknown"


def incidence(orders: DataFrame, key: str = "order_id", ip: str = "ip_address", user: str = "user_id") -> DataFrame:
    """(order, attribute node) rows: the bipartite form of the order graph."""
    by_ip = orders.filter(F.col(ip).isNotNull() & (F.col(ip) != UNKNOWN_IP)) \
                  .select(key, F.concat(F.lit("ip:"), F.col(ip)).alias("node"))
    by_user = orders.filter(F.col(user).isNotNull()) \
                    .select(key, F.concat(F.lit("user:"), F.col(user)).alias("node"))
    return by_ip.unionByName(by_user)


def standardized_amount(orders: DataFrame, amount: str = "order_amount") -> DataFrame:
    """(amount - mean) / population std over all orders (std 0 -> 1)."""
    s = one_row(orders.agg(F.avg(F.col(amount).cast("double")).alias("m"),
                           F.stddev_pop(F.col(amount).cast("double")).alias("s")))
    sd = F.lit(s.s if s.s else 1.0)
    return orders.withColumn("x", (F.col(amount).cast("double") - F.lit(s.m)) / sd)


def _compact(c: Column) -> Column:
    """The same keys in fewer bytes: a hash in hexadecimal digits takes half of them, other text stays; a first byte tells them apart."""
    return F.when(c.rlike("^[0-9a-f]{64}$"), F.concat(F.unhex(F.lit("01")), F.unhex(c))).otherwise(F.concat(F.unhex(F.lit("00")), c.cast("binary")))


def _keyed(df: DataFrame, ip: str, user: str) -> DataFrame:
    """With ``__ip`` and ``__user``, the keys that link; an unknown IP links nothing."""
    return df.withColumns({"__ip": F.when(F.col(ip) != UNKNOWN_IP, _compact(F.col(ip))), "__user": _compact(F.col(user))})


def _pairs(keyed: DataFrame, value: str) -> DataFrame:
    """Rows, values and sum of the values for each (IP, user)."""
    return keyed.groupBy("__ip", "__user").agg(F.count(F.lit(1)).alias("__n"), F.count(value).alias("__m"), F.sum(value).alias("__s"))


def _around(pairs: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Each pair with ``__deg``, the neighbours of any of its rows, and ``__around``, the sum over all rows that share IP or
    user with it, its own among them (null where no such row has a value)."""
    ip, user = F.col("__ip").isNotNull(), F.col("__user").isNotNull()
    gi = pairs.filter(ip).groupBy("__ip").agg(F.sum("__n").alias("__gi_n"), F.sum("__s").alias("__gi_s"))
    gu = pairs.filter(user).groupBy("__user").agg(F.sum("__n").alias("__gu_n"), F.sum("__s").alias("__gu_s"))
    j = pairs.join(gi, "__ip", "left").join(gu, "__user", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = some("__gi_n") + some("__gu_n") - F.when(ip & user, F.col("__n")).otherwise(0)
    total = some("__gi_s") + some("__gu_s") - F.when(ip & user, some("__s")).otherwise(0)
    return j.select("__ip", "__user", "__n", "__m", "__s", *kept, (rows - (ip | user).cast("long")).alias("__deg"),
                    F.when(F.coalesce("__gi_s", "__gu_s").isNotNull(), total).alias("__around"))


def _mean_around(value: Column, deg: str, around: str) -> Column:
    """Mean over a row's neighbours: what is around its pair, less the row itself."""
    here = F.when(F.col(around).isNotNull(), F.col(around) - value).otherwise(F.lit(0.0))
    return F.when(F.col(deg) > 0, here / F.col(deg).cast("double"))


def neighbour_mean(df: DataFrame, value: str, out: str, ip: str = "ip_address", user: str = "user_id") -> DataFrame:
    """Mean of ``value`` over each order's neighbours, and its degree.

    Orders sharing IP and user are counted once (inclusion-exclusion); an
    'unknown' or NULL IP links nothing. Isolated orders get mean NULL and
    degree 0. Sums are built over (IP, user) pairs, so the orders are joined once.
    """
    d = _keyed(df, ip, user)
    around = _around(_pairs(d, value)).select("__ip", "__user", "__deg", "__around")
    j = join_null_safe(d, around, ["__ip", "__user"], "left")
    return j.select(*df.columns, F.col("__deg").alias(f"{out}_degree"), _mean_around(F.col(value), "__deg", "__around").alias(out))


def neighbour_features(orders: DataFrame, key: str = "order_id") -> DataFrame:
    """Standardized amount, its 1-hop neighbour mean and the 2-hop mean of
    1-hop means (what two mean-aggregating GraphSAGE layers consume).

    All orders of an (IP, user) pair have the same neighbours and themselves, so the 1-hop means of a pair
    add up to (values x what is around - their sum) / degree: both hops are summed over pairs, and the
    orders are joined once.
    """
    d = _keyed(standardized_amount(orders), "ip_address", "user_id")
    one = cut_lineage(_around(_pairs(d, "x")))
    means = F.when((F.col("__deg") > 0) & F.col("__around").isNotNull(),
                   (F.col("__m") * F.col("__around") - F.coalesce("__s", F.lit(0.0))) / F.col("__deg").cast("double")).otherwise(F.lit(0.0))
    two = _around(one.select("__ip", "__user", "__n", F.col("__n").alias("__m"), means.alias("__s"), F.col("__around").alias("__hop1")), ["__hop1"])
    j = join_null_safe(d, two.select("__ip", "__user", "__deg", "__hop1", "__around"), ["__ip", "__user"], "left")
    j = j.withColumn("hop1_mean", _mean_around(F.col("x"), "__deg", "__hop1"))
    return j.select(key, "user_id", "ip_address", "is_fraud", F.col("x").alias("amount_std"), F.col("__deg").alias("degree"), "hop1_mean",
                    _mean_around(F.coalesce("hop1_mean", F.lit(0.0)), "__deg", "__around").alias("hop2_mean"))


def connected_components(orders: DataFrame, key: str = "order_id", hubs: int = HUBS, least: int = HUB_ROWS) -> DataFrame:
    """(order, component) with the component labelled by its smallest order key."""
    inc = cut_lineage(incidence(orders, key))
    centre = cut_lineage(inc.groupBy("node").agg(F.min(key).alias("b"), F.count(F.lit(1)).alias("__n")))
    edges = split_join(inc, centre.drop("__n"), "node", hub_keys(centre, "node", hubs, least)).select(F.col(key).alias("a"), "b")
    found = cut_lineage(components(edges, hubs, least).withColumnRenamed("v", key))
    # An order id is a row each here, so this join has no hot key.
    return (orders.select(key).distinct().join(found, key, "left")
            .select(key, F.coalesce("component", key).alias("component")))


def rings(orders: DataFrame, key: str = "order_id") -> DataFrame:
    """Components with their size and fraud share (percent, 2 decimals)."""
    from orderflow.functions.exact import ratio_round
    comp = connected_components(orders, key)
    j = comp.join(orders.select(key, F.col("is_fraud").cast("long").alias("f")), key)
    g = j.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("f").alias("fraud_orders"))
    return g.withColumn("fraud_share_pct", ratio_round(F.col("fraud_orders") * 100, "size", 2, 10))
