"""Comparison of two values and of two texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.numbers import display_number, strip

NULL_POLICIES = ("match", "strict")


def relative_difference(published: Column, source: Column) -> Column:
    """`|a - b| / max(|a|, |b|, 1)`; null when a side is null."""
    return F.abs(published - source) / F.when(
        published.isNotNull() & source.isNotNull(),
        F.greatest(F.abs(published), F.abs(source), F.lit(1.0)),
    )


def value_status(
    published: Column, source: Column, tolerance: Column, null_policy: str = "match"
) -> Column:
    """`match`, `mismatch`, `both_null`, `published_null`, `source_null` or `not_a_number`.

    `null_policy` only matters to `passes`: with `match` two nulls agree, with
    `strict` a null never passes.
    """
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}")
    within = relative_difference(published, source) <= tolerance
    return (
        F.when(published.isNull() & source.isNull(), F.lit("both_null"))
        .when(published.isNull(), F.lit("published_null"))
        .when(source.isNull(), F.lit("source_null"))
        .when(F.isnan(published) | F.isnan(source), F.lit("not_a_number"))
        .when(within, F.lit("match"))
        .otherwise(F.lit("mismatch"))
    )


def passes(status: Column, null_policy: str = "match") -> Column:
    accepted = ["match", "both_null"] if null_policy == "match" else ["match"]
    return status.isin(accepted)


def text_matches(raw: Column, expected: Column) -> Column:
    """Case-blind: the trimmed expected text occurs in the captured text."""
    return F.coalesce(
        F.contains(F.lower(strip(raw)), F.lower(strip(expected))), F.lit(False)
    )


def extracted(raw: Column) -> Column:
    """Extraction-only verdict: there is a value and it reads as a number."""
    return display_number(raw).isNotNull()


def selection_matches(values: Column, expected: Column) -> Column:
    """Slicer state against the expected value."""
    want = strip(F.coalesce(expected, F.lit("")))
    return F.coalesce(
        F.array_contains(values, want)
        | ((F.lower(want) == "all") & (values == F.array(F.lit("All"))))
        | (F.array_join(values, ", ") == want),
        F.lit(False),
    )
