"""Inventory of captured visuals and its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.classify import category, extraction_method, locating_strategy
from tallymark.operators.visuals import expand_visuals, headings

METHODS = ["aria", "show_as_table", "unknown"]


def classified(raw: DataFrame, indexed: bool = False) -> DataFrame:
    """Visuals with title, category and locating strategy.

    Row by row and without a shuffle, unless `indexed` asks for the type index.
    """
    return (
        expand_visuals(raw, indexed).withColumns({
            "category": category(F.col("type"), F.col("title"), F.col("full_text")),
            "strategy": locating_strategy(F.col("title"), F.col("noisy")),
        })
    )


def visual_inventory(raw: DataFrame) -> DataFrame:
    """`classified` with the type index and, for charts titled by noise, the heading."""
    found = headings(expand_visuals(raw))
    return classified(raw, indexed=True).join(found, ["page", "ordinal"], "left")


def page_counts(inventory: DataFrame) -> DataFrame:
    """KPIs, charts and slicers per page, with the total under a null page."""
    def of(kind: str):
        return F.count_if(F.col("category") == kind)

    return inventory.rollup("page").agg(
        of("kpi").alias("kpis"), of("chart").alias("charts"), of("slicer").alias("slicers"),
        F.count(F.lit(1)).alias("visuals"))


def extraction_coverage(inventory: DataFrame) -> DataFrame:
    """Charts per extraction method, methods without charts included."""
    def of(name: str):
        return F.count_if(F.col("method") == name).alias(name)

    charts = inventory.where(F.col("category") == "chart").withColumn(
        "method", extraction_method(F.col("type")))
    wide = charts.agg(*[of(m) for m in METHODS])
    return wide.unpivot([], [F.col(m) for m in METHODS], "method", "charts")


def charts_by_method(inventory: DataFrame) -> DataFrame:
    """The charts behind `extraction_coverage`, one row per chart."""
    return inventory.where(F.col("category") == "chart").select(
        extraction_method(F.col("type")).alias("method"), "page", "ordinal",
        F.coalesce(F.nullif("title", F.lit("")), F.col("type")).alias("title"))


def confidence_histogram(suggestions: DataFrame) -> DataFrame:
    levels = ["HIGH", "MEDIUM", "LOW", "NONE"]
    wide = suggestions.agg(*[
        F.count_if(F.col("confidence") == level).alias(level) for level in levels])
    return wide.unpivot([], [F.col(level) for level in levels], "confidence", "suggestions")
