"""All registered queries. Importing this module imports every catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderflow.operators import staging as stg_ops
from orderflow.plans import marts
from orderflow.plans import oracle as O
from orderflow.plans.catalog_base import ORACLE, QUERIES, Query, register
from orderflow.plans.context import OrderContext

__all__ = ["ORACLE", "QUERIES", "Query", "register"]


# -- staging and marts -------------------------------------------------------

@register("prj_staging_orders", O.STAGING_ORDERS)
def _staging(ctx: OrderContext) -> DataFrame:
    return ctx.staging


@register("mart_fraud_daily", O.FRAUD_DAILY)
def _fraud_daily(ctx: OrderContext) -> DataFrame:
    return marts.fraud_daily(ctx.staging, ctx.as_of)


@register("mart_dim_products", O.DIM_PRODUCTS)
def _dim_products(ctx: OrderContext) -> DataFrame:
    return marts.dim_products(ctx.staging, ctx.as_of)


@register("mart_dim_users", O.DIM_USERS)
def _dim_users(ctx: OrderContext) -> DataFrame:
    return marts.dim_users(ctx.staging, ctx.as_of)


@register("mart_fct_fraud_orders", O.FCT_FRAUD_ORDERS)
def _fct_fraud_orders(ctx: OrderContext) -> DataFrame:
    return marts.fct_fraud_orders(ctx.staging, ctx.as_of)


@register("mart_dim_time", O.DIM_TIME)
def _dim_time(ctx: OrderContext) -> DataFrame:
    return marts.dim_time(ctx.staging)


@register("mart_fact_orders", O.FACT_ORDERS)
def _fact_orders(ctx: OrderContext) -> DataFrame:
    return marts.fact_orders(stg_ops.staging_orders(ctx.processed, extra=("product_id", "quantity", "payment_method")))


# Further catalogues register themselves on import.
from orderflow.plans import catalog_ops  # noqa: E402,F401
from orderflow.plans import catalog_ml  # noqa: E402,F401
from orderflow.plans import catalog_more  # noqa: E402,F401
from orderflow.plans import catalog_forecast  # noqa: E402,F401
from orderflow.plans import catalog_graph  # noqa: E402,F401
