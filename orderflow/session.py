"""Session construction and cluster-safe lineage cuts.

Library functions never build a session themselves; they take the caller's
session. ``build_session`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Conf keys this package relies on.
CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings for a large cluster reading ~100 TB (passed to spark-submit by the
# operator; nothing here sets them on a live cluster). Shuffle partitions start
# high and AQE coalesces them to ~256 MB; skewed join partitions are split;
# scan splits stay at 512 MB so a task's input fits executor memory.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.shuffle.partitions": "40000",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "orderflow") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("ORDERFLOW_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings every query in this package assumes.

    Timestamps in the inputs are zone-less; all wall-clock arithmetic is done
    in UTC so that hours, dates and epoch offsets are the same on every
    executor and match the oracle.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage and is
    used as given. Only when it is unset *and* the master is local (tests,
    bench) do we pick a private temporary folder.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; iterative jobs need a shared checkpoint folder"
        )
    path = tempfile.mkdtemp(prefix="orderflow-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_estimates(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for loops: the planner's estimates and constraints are cut as well.

    A checkpoint keeps the size that the planner had estimated, which for a join is the product of its
    sides'. Joined round after round, that number has thrice as many digits each time, and planning a few rows takes minutes.
    """
    spark, kept = df.sparkSession, cut_lineage(df)
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
