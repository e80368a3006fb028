"""Session helpers: table loading, the shared folder and durable cut points."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    A local temporary folder is used only when the setting is absent and the
    session runs in one process (tests).
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="tallymark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, one per call."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it does when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
