"""Sinks: idempotent micro-batch writers, archive, dead letter, upserts, logs.

All paths are in shared storage (a table location, or a folder beside the
checkpoints). A retried micro-batch replaces its own folders.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A folder under the cluster's shared checkpoint location."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


def write_partitions(df: DataFrame, path: str, batch_id: int, by: tuple[str, ...] = ("order_date",)) -> None:
    """Write one batch under ``path/<date>/batch_id=<n>``: dates first, so a filter on the
    date lists only its folders. A repeated batch replaces its own folders."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch_id").parquet(path))


def _folders(spark: SparkSession, path: str, pattern: str):
    """(file system, folders under ``path`` that match), by Spark's own file systems."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, [f.getPath() for f in (fs.globStatus(hadoop(f"{path}/{pattern}")) or [])]


def remove(spark: SparkSession, path: str, pattern: str) -> None:
    """Remove the folders under ``path`` that match."""
    fs, found = _folders(spark, path, pattern)
    for folder in found:
        fs.delete(folder, True)


def clear_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove what an earlier attempt at a batch has written, under whatever date."""
    for pattern in (f"batch_id={batch_id}", f"*/batch_id={batch_id}"):
        remove(spark, path, pattern)


def expire(spark: SparkSession, path: str, column: str, gone: Callable[[str], bool]) -> list[str]:
    """Remove the partitions ``column=<value>`` whose value is ``gone``; the values removed."""
    fs, found = _folders(spark, path, f"{column}=*")
    out = []
    for folder in found:
        value = folder.getName().split("=", 1)[1]
        if value != "__HIVE_DEFAULT_PARTITION__" and gone(value):
            fs.delete(folder, True)
            out.append(value)
    return sorted(out)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All batches written by ``write_partitions``."""
    return spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))


def read_table_or_none(spark: SparkSession, path: str, where: Column, batches: bool = True) -> DataFrame | None:
    """The rows that match, or None if nothing has been written there yet."""
    try:
        return (read_table(spark, path) if batches else spark.read.parquet(path)).filter(where)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Insert or replace on key conflict: the row with the greatest ``order_col`` wins
    (ties go to the incoming row)."""
    both = (existing.withColumn("__src", F.lit(0))
            .unionByName(incoming.withColumn("__src", F.lit(1)), allowMissingColumns=True))
    packed = F.struct(F.col(order_col), F.col("__src"), *[F.col(c) for c in both.columns
                                                         if c not in keys and c not in (order_col, "__src")])
    latest = both.groupBy(*keys).agg(F.max(packed).alias("__r"))
    return latest.select(*keys, "__r.*").drop("__src")


def append_log(df: DataFrame, path: str) -> None:
    """Append-only event log (shadow scores, features, feedback, performance)."""
    df.write.mode("append").parquet(path)


def reference_sample(df: DataFrame, key: str, n: int = 5000) -> DataFrame:
    """Deterministic sample of ``n`` rows: those whose key has the smallest MD5."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), F.col(key)).limit(n)


def materialize_views(builders: Mapping[str, Callable[[], DataFrame]], views: tuple[str, ...],
                      location: str) -> dict[str, DataFrame]:
    """Build models in dependency order: those in ``views`` become temp views, the others
    tables (``saveAsTable``, Parquet under ``location``)."""
    out: dict[str, DataFrame] = {}
    for name, build in builders.items():
        df = build()
        if name in views:
            df.createOrReplaceTempView(name)
        else:
            df.write.mode("overwrite").option("path", os.path.join(location, name)).saveAsTable(name)
        out[name] = df.sparkSession.table(name)
    return out
