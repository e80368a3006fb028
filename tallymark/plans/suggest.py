"""Candidate source queries for visuals, as rows and as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import vocab
from tallymark.functions.text import contains_any, inferred_aggregate
from tallymark.operators.catalog import (
    attach_columns, best_columns, header_sets, match_columns,
)
from tallymark.session import cut


def suggest_kpis(cards: DataFrame, catalog: DataFrame) -> DataFrame:
    """`(…, db_table, db_col, agg, confidence)` for each card `(…, header)`.

    Titles that name a derived measure get no suggestion; an average lowers HIGH to MEDIUM.
    """
    matched = match_columns(cards, catalog)
    usable = (F.col("confidence") != "NONE") & ~contains_any(
        F.lower("header"), vocab.COMPLEX_MEASURE_WORDS)
    guess = F.coalesce(F.nullif(
        inferred_aggregate(F.col("db_col"), F.col("db_type"), F.col("header")), F.lit("")),
        F.lit("SUM"))
    return (
        matched.withColumn("agg", F.when(usable, guess).otherwise(F.lit("")))
        .withColumn("confidence", F.when(~usable, F.lit("NONE")).when(
            (F.col("agg") == "AVG") & (F.col("confidence") == "HIGH"), F.lit("MEDIUM"))
            .otherwise(F.col("confidence")))
        .withColumn("db_table", F.when(usable, F.col("db_table")).otherwise(F.lit("")))
        .withColumn("db_col", F.when(usable, F.col("db_col")).otherwise(F.lit("")))
        .drop("db_type", "is_numeric", "is_date", "is_categorical")
    )


def suggest_tables(headers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Role of each header of a visual in its suggested grouped query.

    `headers(visual_id, col_no, header)`. Gives one row per used header with its table,
    column, role (`key` or `measure`), aggregate and the confidence of the whole set.
    Columns of other tables than the chosen one are left out.
    """
    # Needed twice, and no larger than the distinct headers: kept instead of found again.
    best = cut(best_columns(headers, catalog))
    matched = attach_columns(headers, best)
    chosen = header_sets(matched, ["visual_id"], "col_no").where(
        F.col("db_table").isNotNull()).drop("score")
    kept = matched.drop("confidence").join(chosen, ["visual_id", "db_table"])
    agg = inferred_aggregate(F.col("db_col"), F.col("db_type"))
    # Without any numeric column every column is tried as a measure.
    measure = (F.col("is_numeric") | ~F.col("any_numeric")) & (F.col("guess") != "")
    return kept.withColumn("guess", agg).select(
        "visual_id", "col_no", "header", F.col("db_table").alias("source_table"), "db_col",
        F.when(measure, F.lit("measure")).otherwise(F.lit("key")).alias("role"),
        F.when(measure, F.col("guess")).otherwise(F.lit("")).alias("agg"), "confidence")


def suggest_for_inventory(inventory: DataFrame, headers: DataFrame,
                          catalog: DataFrame) -> DataFrame:
    """Confidence and table per KPI and chart visual; visuals without a match get NONE.

    `inventory(visual_id, category, title, heading)`, `headers(visual_id, col_no, header)`.
    """
    cards = inventory.where(F.col("category") == "kpi").select(
        "visual_id", F.coalesce("heading", "title").alias("header"))
    kpis = suggest_kpis(cards, catalog).select("visual_id", "db_table", "confidence")
    charts = inventory.where(F.col("category") == "chart").select("visual_id")
    shown = match_columns(headers.join(charts, "visual_id", "left_semi"), catalog)
    tables = header_sets(shown, ["visual_id"], "col_no").select(
        "visual_id", "db_table", "confidence")
    found = kpis.unionByName(tables)
    return (
        inventory.where(F.col("category").isin("kpi", "chart")).select("visual_id", "category")
        .join(found, "visual_id", "left")
        .fillna({"db_table": "", "confidence": "NONE"})
    )


def grouped_query(df: DataFrame, roles: list[tuple[str, str, str, str]]) -> DataFrame:
    """The suggested query of one visual: `(header, column, role, agg)` per header."""
    functions = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg}
    keys = [F.col(column).alias(header) for header, column, role, _ in roles if role == "key"]
    measures = [functions[agg](column).alias(header)
                for header, column, role, agg in roles if role == "measure"]
    if not measures:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*measures)
