"""A stored table with upsert: only touched partitions are written anew, and all of them appear at once.

``data/<by>=<value>/version=<n>`` holds the rows of a partition as of run n, ``manifest/version=<n>``
which version of each partition is valid after run n (a row a partition, one file). Readers take
the newest manifest, so a run is seen whole when its manifest is there, and not at all before.
The versions of the manifest before stay for readers that have begun; older ones are removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.sources import sinks


@dataclass(frozen=True)
class StoredTable:
    path: str
    keys: tuple[str, ...]
    order_col: str              # the row with its greatest value wins; ties go to the incoming row
    by: str                     # partition column (a date), in the rows or derived by the caller

    def manifest(self, spark: SparkSession) -> tuple[int, dict[str, int]]:
        """(newest version, version of each partition); a row for each date."""
        rows = sinks.read_table_or_none(spark, f"{self.path}/manifest", F.lit(True), batches=False)
        last = None if rows is None else rows.agg(F.max("version")).first()[0]
        if last is None:
            return 0, {}
        return last, {r.part: r.part_version for r in rows.filter(F.col("version") == last).collect()}

    def _read(self, spark: SparkSession, parts: dict[str, int]) -> DataFrame | None:
        folders = [f"{self.path}/data/{self.by}={p}/version={v}" for p, v in sorted(parts.items())]
        return spark.read.option("basePath", f"{self.path}/data").parquet(*folders).drop("version") if folders else None

    def read(self, spark: SparkSession, wanted: Callable[[str], bool] = lambda part: True) -> DataFrame | None:
        """The rows of the partitions that are ``wanted``; no other folder is listed. None if there are none."""
        return self._read(spark, {p: v for p, v in self.manifest(spark)[1].items() if wanted(p)})

    def merge(self, incoming: DataFrame) -> list[str]:
        """Insert or replace the rows of ``incoming``; the partitions written."""
        spark = incoming.sparkSession
        last, parts = self.manifest(spark)
        touched = sorted(str(r[0]) for r in incoming.select(F.col(self.by).cast("string")).distinct().collect())   # dates of one run
        version = last + 1
        for folder in ("data/*", "manifest"):       # left by a run that failed
            sinks.remove(spark, self.path, f"{folder}/version={version}")
        if not touched:
            return []
        old = self._read(spark, {p: v for p, v in parts.items() if p in touched})
        existing = old if old is not None else incoming.limit(0)
        merged = sinks.upsert_latest(existing, incoming, list(self.keys), self.order_col)
        merged.withColumn("version", F.lit(version)).write.mode("append").partitionBy(self.by, "version").parquet(f"{self.path}/data")
        valid = parts | dict.fromkeys(touched, version)
        rows = spark.createDataFrame(sorted(valid.items()), "part string, part_version long").coalesce(1)
        rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{self.path}/manifest")
        for p in touched:
            if p in parts:
                sinks.expire(spark, f"{self.path}/data/{self.by}={p}", "version", lambda v, kept=parts[p]: int(v) < kept)
        sinks.expire(spark, f"{self.path}/manifest", "version", lambda v: int(v) < last)
        return touched
