"""Scalar queries given as text in spec rows."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries that are answered by one job.
BATCH = 32
NOT_ONE_COLUMN = "NOT_ONE_COLUMN"


def _condition(error: Exception) -> str:
    """Name of an error, without positions and values; errors of a running query carry it in their text."""
    name = error.getCondition() if isinstance(error, PySparkException) else None
    told = re.search(r"\[([A-Z][A-Z0-9_]+)[.\]]", str(error))
    return name.split(".")[0] if name else told[1] if told else type(error).__name__


def _analysed(spark: SparkSession, text: str) -> DataFrame:
    """`text` as a relation, so that only queries are read and no command is run."""
    return spark.sql(f"SELECT * FROM (\n{text.strip().rstrip(';')}\n)")


def _answers(spark: SparkSession, plans: list[DataFrame]) -> list[tuple[float | None, str | None]]:
    """(value, error) of each plan: one job for all of them, and one each where that job fails.

    The plans become scalar subqueries of one row, so Spark can merge those that aggregate one table.
    """
    def scalar(df: DataFrame):
        return df.toDF("value").select(F.col("value").cast("double")).limit(1).scalar()

    try:
        row = spark.range(1).select(*[scalar(df).alias(f"q{i}") for i, df in enumerate(plans)]).first()
        return [(v, None) for v in row]
    except Exception as error:  # whatever a given text can raise
        if len(plans) == 1:
            return [(None, _condition(error))]
        return [_answers(spark, [df])[0] for df in plans]


def query_values(specs: DataFrame, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """`(sql_query, value, error)` of every distinct text of `specs(sql_query)` that is not blank.

    The value is the first row of the only column as a number, null when there is no row. A text that
    cannot be read, does not give one column or fails while it runs has a null value and the name of
    its error; the others are not affected. Texts with equal plans are answered once. Distinct texts are
    planned on the driver, as by any client of a database, and answered in jobs of `BATCH` plans.
    """
    spark = specs.sparkSession
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    texts = [r[0] for r in specs.select("sql_query").where(
        F.trim("sql_query") != "").distinct().orderBy("sql_query").toLocalIterator()]
    plans: list[DataFrame] = []
    by_hash: dict[int, list[int]] = {}
    place: dict[str, int | str] = {}
    for text in texts:
        try:
            df = _analysed(spark, text)
        except Exception as error:  # the parser and the analyser raise many kinds
            place[text] = _condition(error)
            continue
        if len(df.columns) != 1:
            place[text] = NOT_ONE_COLUMN
            continue
        alike = by_hash.setdefault(df.semanticHash(), [])
        same = next((i for i in alike if plans[i].sameSemantics(df)), None)
        if same is None:
            same = len(plans)
            plans.append(df)
            alike.append(same)
        place[text] = same
    answers = [a for i in range(0, len(plans), BATCH) for a in _answers(spark, plans[i:i + BATCH])]
    rows = [(t, *(answers[p] if isinstance(p, int) else (None, p))) for t, p in place.items()]
    return spark.createDataFrame(rows, "sql_query string, value double, error string")
