"""Lazily built, shared inputs of the order pipeline for one data folder.

Each attribute is a DataFrame that downstream queries extend; ``as_of`` runs one
small job (the newest event) and is a literal from then on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession

from orderflow.operators import staging
from orderflow.sources import adapter
from orderflow.sources.tables import table


@dataclass
class OrderContext:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def raw(self) -> DataFrame:
        return adapter.raw_orders(self.spark, self.sf_dir)

    @cached_property
    def as_of(self) -> Column:
        return adapter.as_of_clock(self.spark, self.sf_dir)

    @cached_property
    def hash_key(self) -> str:
        """The session's key, else the one that the queries' SQL names: that fixes their rows on a cluster too."""
        return self.spark.conf.get(staging.USER_HASH_CONF, None) or staging.USER_HASH_KEY

    @cached_property
    def processed(self) -> DataFrame:
        return staging.processed_orders(self.raw, self.as_of, self.hash_key)

    @cached_property
    def rejected(self) -> DataFrame:
        return staging.rejected_orders(self.raw, self.as_of)

    @cached_property
    def staging(self) -> DataFrame:
        return staging.staging_orders(self.processed)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)
