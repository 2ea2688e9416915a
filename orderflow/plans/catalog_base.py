"""Query registration: ``register(name, oracle_sql)`` collects callables
``(spark, sf_dir) -> DataFrame`` and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderflow.plans.context import OrderContext

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[OrderContext], DataFrame]) -> Callable[[OrderContext], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(OrderContext(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
