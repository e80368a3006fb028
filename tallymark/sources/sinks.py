"""Result sink: dated history, with the latest run as a view over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(verdicts: DataFrame, path: str, run_ts: Column, suite: Column,
                  files_per_day: int | None = None) -> None:
    """Append verdicts of a run, partitioned by suite and day.

    Without `files_per_day` each task writes its own files, with no shuffle; with it the rows of a day
    go to that many tasks, so a day of any suite has no more files.
    """
    dated = (
        verdicts.withColumn("suite", suite).withColumn("suite_key", F.col("suite"))
        .withColumn("run_ts", run_ts)
        .withColumn("run_date", F.to_date("run_ts"))
    )
    if files_per_day:
        dated = dated.repartition(files_per_day)
    dated.write.mode("append").partitionBy("suite_key", "run_date").parquet(path)


def latest_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the latest run of each suite.

    The last day of each suite comes from the partition columns; runs are then looked for in those
    partitions only.
    """
    history = spark.read.parquet(path)
    days = history.groupBy("suite_key").agg(F.max("run_date").alias("run_date"))
    recent = history.join(days, ["suite_key", "run_date"], "left_semi").drop("suite_key")
    last = recent.groupBy("suite").agg(F.max("run_ts").alias("run_ts"))
    return recent.join(last, ["suite", "run_ts"], "left_semi")
