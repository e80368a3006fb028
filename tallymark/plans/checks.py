"""KPI, table and health checks over whole spec tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.compare import (
    passes, relative_difference, selection_matches, text_matches, value_status,
)
from tallymark.functions.numbers import comparison_detail, display_number, plain_number
from tallymark.functions.text import error_phrase, human_label
from tallymark.operators.ranking import first_per_group
from tallymark.operators.skew import spread_join
from tallymark.plans.specs import drop_blank, filled

TIERS = ("auto", "dom", "api", "source")


def on_page_or_any(specs: DataFrame, found: DataFrame, title: str, current_page: str | None) -> DataFrame:
    """Specs with the first row of `found` that has their title on their page.

    `found(page, <title>, ordinal, ...)`. A blank page means the current one; without a current page
    such a spec takes the first row with its title on any page. The two kinds of specs meet their
    rows in two joins on equal keys; the page of a spec stays as given.
    """
    rest = [c for c in found.columns if c not in ("page", title, "ordinal")]
    order = [F.col("ordinal"), *[F.col(c) for c in rest]]
    asked = specs.withColumn("__page", F.when(filled("page"), F.col("page")).otherwise(F.lit(current_page)))
    shown = found.withColumn("page", F.coalesce(F.col("page"), F.lit("")))
    here = first_per_group(shown, ["page", title], order).drop("ordinal").withColumnRenamed("page", "__page")
    placed = asked.where(F.col("__page").isNotNull()).join(here, ["__page", title], "left")
    if current_page is None:
        anywhere = first_per_group(shown.drop("page"), [title], order).drop("ordinal")
        placed = placed.unionByName(
            asked.where(F.col("__page").isNull()).join(anywhere, title, "left"))
    return placed.drop("__page")


# --- KPI checks -----------------------------------------------------------------

def kpi_mode(has_sql: Column, has_file: Column, expected: Column, is_text: Column) -> Column:
    """Where the value of a KPI comes from. What is configured decides, not what is null."""
    return (
        F.when(has_sql, F.lit("sql"))
        .when(has_file, F.lit("file"))
        .when(expected.isNotNull() & F.coalesce(is_text, F.lit(False)), F.lit("expected_text"))
        .when(expected.isNotNull(), F.lit("expected_value"))
        .otherwise(F.lit("extraction_only"))
    )


def validate_kpis(specs: DataFrame, captured: DataFrame, values: DataFrame,
                  current_page: str | None = None) -> DataFrame:
    """Verdict of every KPI spec, one each.

    `specs(spec_id, page, visual_title, has_sql, has_file, expected_value, is_text,
    tolerance)`, `captured(page, visual_title, ordinal, raw)`, `values(spec_id, sql_value,
    file_value)`. Of several captures the first by `ordinal` counts; for a blank page see
    `on_page_or_any`. A KPI that was not captured fails. `detail` explains the verdict of
    compared figures.
    """
    shown = captured.select("page", "visual_title", "ordinal", "raw", F.lit(True).alias("captured"))
    joined = on_page_or_any(specs, shown, "visual_title", current_page).join(values, "spec_id", "left")
    mode = kpi_mode(F.col("has_sql"), F.col("has_file"), F.col("expected_value"), F.col("is_text"))
    source = (
        F.when(F.col("mode") == "sql", F.col("sql_value"))
        .when(F.col("mode") == "file", F.col("file_value"))
        .when(F.col("mode") == "expected_value", plain_number(F.col("expected_value")))
    )
    compared = value_status(F.col("published"), F.col("source"), F.col("tolerance"))
    status = (
        F.when(F.col("captured").isNull(), F.lit("not_captured"))
        .when(F.col("mode") == "expected_text",
              F.when(text_matches(F.col("raw"), F.col("expected_value")), F.lit("match"))
              .otherwise(F.lit("mismatch")))
        .when(F.col("mode") == "extraction_only",
              F.when(F.col("published").isNotNull(), F.lit("extracted"))
              .otherwise(F.lit("not_parsed")))
        .when((F.col("mode") == "expected_value") & F.col("source").isNull(),
              F.lit("bad_expected_value"))
        .otherwise(compared)
    )
    return (
        joined.withColumn("mode", mode)
        .withColumn("published", display_number(F.col("raw")))
        .withColumn("source", source)
        .withColumn("status", status)
        .withColumn("passed", passes(F.col("status")) | (F.col("status") == "extracted"))
        .withColumn("detail", F.when(
            F.col("mode").isin("sql", "file", "expected_value")
            & ~F.col("status").isin("not_captured", "bad_expected_value"),
            comparison_detail(
                human_label(F.col("visual_title"), F.lit("KPI"), F.lit(None).cast("int")), F.col("raw"),
                F.col("published"), F.col("source"),
                relative_difference(F.col("published"), F.col("source")), F.col("tolerance"),
                F.col("passed"))).otherwise(F.col("status")))
        .select("spec_id", "page", "visual_title", "mode", "raw", "published", "source",
                "tolerance", "status", "passed", "detail")
    )


# --- Table checks ---------------------------------------------------------------

def source_health(sources: dict[str, DataFrame]) -> DataFrame:
    """`(source, has_rows)`; each source is read until its first row and no further.

    The probe tries one partition and widens only while it finds nothing, where a limit
    inside a larger query would touch every partition.
    """
    spark = next(iter(sources.values())).sparkSession
    found = [(name, not df.isEmpty()) for name, df in sources.items()]
    return spark.createDataFrame(found, "source string, has_rows boolean")


def route(tier: Column, has_api: Column, has_source: Column, dom_rows: Column,
          api_rows: Column) -> Column:
    """Tier a visual is checked on: first the captured table, then the API, then the source."""
    tier = F.lower(F.coalesce(F.nullif(tier, F.lit("")), F.lit("auto")))
    use_dom, use_api = tier.isin("auto", "dom"), tier.isin("auto", "api")
    return (
        F.when(use_dom & (dom_rows > 0), F.lit("dom"))
        .when(tier == "dom", F.lit("dom_failed"))
        .when(use_api & has_api & (api_rows > 0), F.lit("api"))
        .when((tier == "api") & ~has_api, F.lit("api_unavailable"))
        .when(tier == "api", F.lit("api_failed"))
        .when(tier.isin("auto", "source") & has_source, F.lit("source"))
        .when(tier.isin("auto", "source"), F.lit("source_unavailable"))
        .otherwise(F.lit("unknown"))
    )


def _rows_per_visual(cells: DataFrame, out: str) -> DataFrame:
    return cells.groupBy("visual_id").agg(F.count_if(F.col("col_no") == 0).alias(out))


def validate_tables(specs: DataFrame, dom: DataFrame, api: DataFrame, source: DataFrame,
                    null_policy: str = "match") -> DataFrame:
    """Verdict of every table spec in one job.

    `specs(visual_id, tier, has_api, has_source, has_columns, tolerance)`;
    `dom`, `api` `(visual_id, row_key, col_no, col_name, raw)` and
    `source(visual_id, row_key, col_no, col_name, value)` hold one row per cell. Cells meet
    on visual, row key and column. Specs without keys and columns compare row counts.
    """
    planned = specs
    for cells, out in ((dom, "dom_rows"), (api, "api_rows"), (source, "src_rows")):
        planned = planned.join(_rows_per_visual(cells, out), "visual_id", "left")
    planned = planned.fillna(0, ["dom_rows", "api_rows", "src_rows"]).withColumn(
        "tier_used", route(F.col("tier"), F.col("has_api"), F.col("has_source"),
                           F.col("dom_rows"), F.col("api_rows")))
    shown_rows = F.when(F.col("tier_used") == "dom", F.col("dom_rows")).when(
        F.col("tier_used") == "api", F.col("api_rows"))
    planned = planned.withColumn("published_rows", shown_rows)

    columns = ["visual_id", "row_key", "col_name"]
    tagged = reduce(DataFrame.unionByName, [
        dom.select(*columns, F.lit("dom").alias("side"),
                   display_number(F.col("raw")).alias("value")),
        api.select(*columns, F.lit("api").alias("side"),
                   display_number(F.col("raw")).alias("value")),
        source.select(*columns, F.lit("source").alias("side"),
                      F.col("value").cast("double").alias("value")),
    ])
    sides = ("dom", "api", "source")
    # All three sides meet in one aggregation; the tier picks the side afterwards.
    aligned = tagged.groupBy(*columns).agg(
        *[F.max(F.when(F.col("side") == s, F.col("value"))).alias(f"{s}_value") for s in sides],
        *[F.count_if(F.col("side") == s).alias(f"{s}_cells") for s in sides],
    )
    compared = planned.where(
        F.col("has_columns") & F.col("has_source") & F.col("tier_used").isin("dom", "api")
    ).select("visual_id", "tier_used", "tolerance")
    on_dom = F.col("tier_used") == "dom"
    shown_cells = F.when(on_dom, F.col("dom_cells")).otherwise(F.col("api_cells"))
    shown = F.when(on_dom, F.col("dom_value")).otherwise(F.col("api_value"))
    status = (
        F.when(shown_cells == 0, F.lit("missing_in_published"))
        .when(F.col("source_cells") == 0, F.lit("missing_in_source"))
        .when((shown_cells > 1) | (F.col("source_cells") > 1), F.lit("duplicate_key"))
        .otherwise(value_status(shown, F.col("source_value"), F.col("tolerance"), null_policy))
    )
    # The cells of one visual may be most of the data, hence the spread.
    failed = (
        spread_join(aligned, compared, ["visual_id"], ["row_key", "col_name"])
        .where((shown_cells > 0) | (F.col("source_cells") > 0))
        .groupBy("visual_id")
        .agg(F.count(F.lit(1)).alias("cells"),
             F.count_if(~passes(status, null_policy)).alias("failed_cells"))
    )
    rows_equal = F.col("published_rows") == F.col("src_rows")
    passed = (
        F.when(F.col("tier_used") == "source", F.col("src_rows") > 0)
        .when(~F.col("tier_used").isin("dom", "api") | ~F.col("has_source"), F.lit(False))
        .when(~F.col("has_columns"), rows_equal)
        .otherwise(rows_equal & (F.col("failed_cells") == 0))
    )
    return (
        planned.join(failed, "visual_id", "left")
        .fillna(0, ["cells", "failed_cells"])
        .withColumn("passed", passed)
        .select("visual_id", "tier_used", "published_rows", "src_rows", "cells",
                "failed_cells", "passed")
    )


# --- Health checks --------------------------------------------------------------

def error_banners(pages: DataFrame) -> DataFrame:
    """`(page, phrase)` of pages whose text shows a known error."""
    return pages.select("page", error_phrase(F.col("text")).alias("phrase")).where(
        F.col("phrase").isNotNull())


def missing_pages(configured: DataFrame, visuals: DataFrame) -> DataFrame:
    """Configured pages that the report does not have; the case of letters counts."""
    wanted = drop_blank(configured, "page").select("page").distinct()
    return wanted.join(visuals.select("page").distinct(), "page", "left_anti")


def missing_visuals(specs: DataFrame, visuals: DataFrame, current_page: str | None = None) -> DataFrame:
    """Titled specs whose visual is not on its page, or whose page is missing.

    A spec without a page means the current one, or any page where none is given. `available`
    counts the titles on the page; `page_titles` lists them.
    """
    pages = visuals.groupBy("page").agg(F.count_distinct("title").alias("available"))
    titles = visuals.select("page", F.col("title").alias("visual_title"), F.lit(0).alias("ordinal"),
                            F.lit(True).alias("__found"))
    wanted = on_page_or_any(drop_blank(specs, "visual_title"), titles, "visual_title", current_page)
    page = F.when(filled("page"), F.col("page")).otherwise(F.lit(current_page))
    return (
        wanted.withColumn("page", page).join(pages, "page", "left")
        .withColumn("reason", F.when(F.col("__found").isNotNull(), F.lit(None)).when(
            F.col("available").isNull() & F.col("page").isNotNull(), F.lit("page_not_found"))
            .otherwise(F.lit("visual_not_found")))
        .where(F.col("reason").isNotNull())
        .select("spec_id", "kind", F.coalesce("page", F.lit("")).alias("page"), "visual_title", "reason",
                F.coalesce("available", F.lit(0)).alias("available"))
    )


def filter_state(specs: DataFrame, slicers: DataFrame, current_page: str | None = None) -> DataFrame:
    """Slicers against their expected value; a slicer that is not there fails.

    `specs(page, slicer_title, expected_value)`, `slicers(page, ordinal, slicer_title, values)`.
    A title refers to the first slicer with it; for a blank page see `on_page_or_any`.
    """
    current = slicers.select("page", "slicer_title", "ordinal", F.col("values").alias("current"))
    return (
        on_page_or_any(drop_blank(specs, "slicer_title"), current, "slicer_title", current_page)
        .withColumn("status", F.when(F.col("current").isNull(), F.lit("not_found"))
                    .when(selection_matches(F.col("current"), F.col("expected_value")),
                          F.lit("match")).otherwise(F.lit("mismatch")))
        .withColumn("passed", F.col("status") == "match")
        .withColumn("current", F.coalesce(F.array_join("current", ", "), F.lit("")))
        .select("page", "slicer_title", "expected_value", "current", "status", "passed")
    )


def health_suite(pages: DataFrame, configured: DataFrame, specs: DataFrame, visuals: DataFrame,
                 filters: DataFrame, slicers: DataFrame, current_page: str | None = None) -> DataFrame:
    """Failures of the four health checks as `(check, page, label, detail)`."""
    def row(df: DataFrame, check: str, label: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), "page", label.alias("label"),
                         detail.alias("detail"))

    return reduce(DataFrame.unionByName, [
        row(error_banners(pages), "load", F.lit(""), F.col("phrase")),
        row(missing_pages(configured, visuals), "page", F.lit(""), F.lit("page_not_found")),
        row(missing_visuals(specs, visuals, current_page), "visual", F.col("visual_title"), F.col("reason")),
        row(filter_state(filters, slicers, current_page).where(~F.col("passed")), "filter",
            F.col("slicer_title"), F.col("status")),
    ])


def verdict_summary(verdicts: DataFrame, by: str = "page") -> DataFrame:
    """Total, passed and failed per page with a grand total (null page)."""
    return verdicts.rollup(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"))


