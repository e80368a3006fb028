"""Classification of visuals, tests and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions import vocab
from tallymark.functions.text import contains_any, lines_of

CHART_TYPES = [t for t in vocab.TESTABLE_TYPES if t not in vocab.KPI_TYPES]


def is_testable(visual_type: Column) -> Column:
    return visual_type.isin(vocab.TESTABLE_TYPES)


def is_skipped(visual_type: Column) -> Column:
    return visual_type.isin(vocab.SKIPPED_TYPES)


def effective_type(visual_type: Column, full_text: Column) -> Column:
    """Untyped visuals that read like a table become `Table`."""
    blank = F.coalesce(visual_type, F.lit("")) == ""
    header_line = F.exists(
        lines_of(full_text), lambda x: F.lower(x).isin(vocab.TABLE_HEADER_LINES)
    )
    looks_tabular = F.trim(full_text).rlike(vocab.TABLE_TEXT_START) | header_line
    return F.when(blank & looks_tabular, F.lit("Table")).otherwise(
        F.coalesce(visual_type, F.lit(""))
    )


def category(visual_type: Column, title: Column, full_text: Column) -> Column:
    """`slicer`, `kpi`, `chart` or `other`."""
    is_kpi = visual_type.isin(vocab.KPI_TYPES)
    parameter = contains_any(title, vocab.PARAMETER_TITLE_WORDS) | (
        ~contains_any(full_text, vocab.FIGURE_TEXT_MARKS)
        & contains_any(full_text, vocab.PARAMETER_TEXT_WORDS)
    )
    return (
        F.when((is_kpi & parameter) | F.contains(F.lower(visual_type), F.lit("slicer")),
               F.lit("slicer"))
        .when(is_kpi, F.lit("kpi"))
        .when(visual_type.isin(CHART_TYPES), F.lit("chart"))
        .otherwise(F.lit("other"))
    )


def locating_strategy(title: Column, noisy: Column) -> Column:
    return F.when(noisy | (F.trim(title) == ""), F.lit("type_index")).otherwise(F.lit("title"))


def extraction_method(visual_type: Column) -> Column:
    return (
        F.when(visual_type.isin(vocab.LABELLED_POINT_TYPES), F.lit("aria"))
        .when(visual_type.isin(vocab.TABULAR_VIEW_TYPES), F.lit("show_as_table"))
        .otherwise(F.lit("unknown"))
    )


def test_group(test_name: Column) -> Column:
    return (
        F.when(F.contains(test_name, F.lit("discover")), F.lit(vocab.GROUP_DISCOVERY))
        .when(F.contains(test_name, F.lit("kpi")), F.lit(vocab.GROUP_KPI))
        .when(F.contains(test_name, F.lit("table")), F.lit(vocab.GROUP_TABLE))
        .otherwise(F.lit(vocab.GROUP_OTHER))
    )


def is_failure_line(level: Column, message: Column) -> Column:
    return (
        (level == "ERROR")
        | F.startswith(message, F.lit("FAIL"))
        | F.contains(message, F.lit("AssertionError"))
    )
