"""Lets Python workers import this package when it isn't installed.

On a cluster the package is shipped with the job (``--py-files``); a session
started from a checkout, from whatever folder, gets the checkout's folder.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def let_workers_import(spark: SparkSession) -> SparkSession:
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in [ROOT, *paths] if p)
    return spark
