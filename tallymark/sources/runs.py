"""Runs of checks: staged rows, committed by a manifest.

Rows are written under a fresh attempt, which nobody reads until the manifest has a line for it. A run
that is written again gets a later line and takes the place of the earlier one; an attempt that fails
leaves rows without a line.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, suite string, run_ts timestamp, attempt string, rows bigint, committed bigint"


def _rows_path(root: str) -> str:
    return f"{root}/rows"


def _manifest_path(root: str) -> str:
    return f"{root}/manifest"


def stage_runs(verdicts: DataFrame, root: str, run_id: Column, suite: Column, run_ts: Column,
               files: int | None = None) -> str:
    """Write the rows of one or more runs under a new attempt and return its name.

    Each task writes its own files, with no shuffle; with `files` the rows go to that many tasks.
    """
    attempt = f"a{uuid.uuid4().hex}"
    staged = verdicts.withColumns({
        "suite": suite, "run_ts": run_ts.cast("timestamp"), "run_id": run_id.cast("string")})
    staged = staged.repartition(files) if files else staged
    staged.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(
        _rows_path(root))
    return attempt


def commit_runs(spark: SparkSession, root: str, attempt: str) -> DataFrame:
    """Make the runs of a staged attempt the ones that readers see; returns their manifest lines.

    The lines are counted from what was written. They are one file, which appears whole or not at all.
    """
    written = spark.read.parquet(_rows_path(root)).where(F.col("attempt") == attempt)
    lines = written.groupBy("run_id", "suite", "run_ts", "attempt").agg(
        F.count(F.lit(1)).alias("rows")).withColumn("committed", F.lit(time.time_ns()))
    lines.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.mode("append").parquet(
        _manifest_path(root))
    return spark.read.schema(MANIFEST).parquet(_manifest_path(root)).where(F.col("attempt") == attempt)


def write_runs(verdicts: DataFrame, root: str, run_id: Column, suite: Column, run_ts: Column,
               files: int | None = None) -> DataFrame:
    """Stage and commit runs. Writing a run again replaces it; a run without rows leaves no trace."""
    attempt = stage_runs(verdicts, root, run_id, suite, run_ts, files)
    return commit_runs(verdicts.sparkSession, root, attempt)


def run_manifest(spark: SparkSession, root: str) -> DataFrame:
    """`(run_id, suite, run_ts, attempt, rows, committed)` of the runs that count, one row each.

    A run is a run id of a suite; of several commits the last one counts.
    """
    lines = spark.read.schema(MANIFEST).parquet(_manifest_path(root))
    last = F.max_by(F.struct("run_ts", "attempt", "rows", "committed"), F.struct("committed", "attempt"))
    return lines.groupBy("run_id", "suite").agg(last.alias("line")).select(
        "run_id", "suite", "line.run_ts", "line.attempt", "line.rows", "line.committed")


def _rows_of(rows: DataFrame, runs: DataFrame) -> DataFrame:
    keys = ["attempt", "run_id", "suite"]
    return rows.join(runs.select(*keys), keys, "left_semi").drop("attempt")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Rows of every committed run."""
    return _rows_of(spark.read.parquet(_rows_path(root)), run_manifest(spark, root))


def latest_runs(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the latest committed run of each suite, by time, then run id.

    Only the folders of those runs are read; their names, no more than there are suites, are collected.
    """
    last = run_manifest(spark, root).groupBy("suite").agg(
        F.max_by(F.struct("run_id", "attempt"), F.struct("run_ts", "run_id")).alias("run")).select(
        "suite", "run.run_id", "run.attempt")
    attempts = [r["attempt"] for r in last.select("attempt").distinct().collect()]
    return _rows_of(spark.read.parquet(_rows_path(root)).where(F.col("attempt").isin(attempts)), last)
