"""Check specs: clean-up, union, order and lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) != ""


def drop_blank(specs: DataFrame, column: str) -> DataFrame:
    return specs.where(filled(column))


def all_specs(kpi_specs: DataFrame, table_specs: DataFrame) -> DataFrame:
    """Titled specs of both kinds with their kind."""
    columns = ["spec_id", "page", "visual_title"]
    both = kpi_specs.select(*columns, F.lit("KPI").alias("kind")).unionByName(
        table_specs.select(*columns, F.lit("Table").alias("kind")))
    return drop_blank(both, "visual_title")


def in_page_order(specs: DataFrame) -> DataFrame:
    """By page, specs without a page first, otherwise as declared."""
    return specs.orderBy(F.coalesce("page", F.lit("")), "spec_id")


def _issues(specs: DataFrame, kind: str, rules: list[tuple[str, Column]]) -> DataFrame:
    raised = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    return specs.select(
        "spec_id", F.lit(kind).alias("kind"), F.explode(raised).alias("issue"))


def lint(kpi_specs: DataFrame, table_specs: DataFrame) -> DataFrame:
    """One row per problem of a spec. An expected value counts as a KPI source."""
    no_source = ~filled("sql_query") & ~filled("file_column") & ~filled("expected_value")

    def empty_list(column: str) -> Column:
        return F.coalesce(F.size(column), F.lit(0)) <= 0

    return _issues(kpi_specs, "kpi", [
        ("visual_title is empty", ~filled("visual_title")),
        ("no source to compare with", no_source),
    ]).unionByName(_issues(table_specs, "table", [
        ("visual_title is empty", ~filled("visual_title")),
        ("no join_keys", empty_list("join_keys")),
        ("no compare_cols", empty_list("compare_cols")),
    ]))


def lint_dashboards(dashboards: DataFrame) -> DataFrame:
    """Dashboards `(spec_id, url)` without an address."""
    return _issues(dashboards, "dashboard", [("url is empty", ~filled("url"))])
