"""Parquet inputs.

Reads are lazy; Catalyst prunes columns and pushes filters into the scan, so
callers select only what they need after ``table(...)``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from orderflow.session import prepare

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    prepare(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
