"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


INPUT_PARTITIONS = "spark.gradeloom.inputPartitions"


def build_session(app: str = "gradeloom", master: str | None = None, input_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs were tuned under; `conf` overrides any of them.

    `input_partitions` is for inputs that lie in fewer pieces than there are cores, such as one file with one row group: tables for
    row-wise work are dealt out into so many tasks. By default they are read as they lie.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # a skewed join may be split even when that costs one more exchange
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # long texts: small batches keep a Python worker's share of memory low
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    if input_partitions:
        settings[INPUT_PARTITIONS] = str(input_partitions)
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see, as the cluster names it in spark.checkpoint.dir.

    Only a local session (all of Spark in one process) may go without the setting: it gets a new temporary
    folder. On a cluster its absence is an error, as executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="gradeloom-")
        sc.setCheckpointDir(configured)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in reliable storage, so that what follows is never recomputed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
