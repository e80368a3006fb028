"""Source aggregates: single figures, batches of KPIs, grouped measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.numbers import plain_number

AGGREGATES = ("sum", "count", "avg", "mean", "min", "max", "count_distinct")


@dataclass(frozen=True)
class Kpi:
    """A named figure of one source: `agg(column)` over the rows that pass `where`."""

    name: str
    agg: str
    column: Column
    where: Column | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Slicer:
    """A selected slicer: its title and the values shown as selected."""

    title: str
    values: Sequence[str]


def _aggregate(agg: str, value: Column) -> Column:
    if agg == "sum":
        # The sum of nothing is 0, as in a spreadsheet, and not null.
        return F.coalesce(F.sum(value), F.lit(0.0))
    if agg == "count":
        return F.count(value).cast("double")
    if agg in ("avg", "mean"):
        return F.avg(value)
    return {"min": F.min, "max": F.max}[agg](value)


def column_aggregates(df: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """One row with `<column>_<agg>` for each column and aggregate, from one scan.

    Columns are read as plain numbers and other content is skipped; a column is parsed
    once for all of its aggregates.
    """
    values = []
    types = dict(df.dtypes)
    for column, aggs in wanted.items():
        for agg in aggs:
            if agg not in AGGREGATES[:-1]:
                raise ValueError(f"Unsupported aggregate '{agg}'. Use one of {AGGREGATES[:-1]}")
        name = column.strip().lower()
        if name not in types:
            raise KeyError(f"Column '{column}' not found. Available: {df.columns}")
        number = F.col(name).cast("double") if types[name] != "string" else plain_number(
            F.col(name))
        values.append(number.alias(name))
    null = F.lit(None).cast("double")
    return df.select(*values).agg(*[
        _aggregate(agg, F.nanvl(F.col(c.strip().lower()), null)).alias(f"{c}_{agg}")
        for c, aggs in wanted.items() for agg in aggs
    ])


def batch_kpis(df: DataFrame, kpis: Sequence[Kpi]) -> DataFrame:
    """`(kpi, value)` for every KPI of one source.

    Plain aggregates share one scan. Distinct counts are grouped by their column
    first, with one flag per filter, so no row is expanded once per KPI.
    """
    for kpi in kpis:
        if kpi.agg not in AGGREGATES:
            raise ValueError(f"Unsupported aggregate '{kpi.agg}'. Use one of {AGGREGATES}")
    keep = {k.name: (k.where if k.where is not None else F.lit(True)) for k in kpis}
    frames = []
    plain = [k for k in kpis if k.agg != "count_distinct"]
    if plain:
        wide = df.agg(*[
            _aggregate(k.agg, F.when(keep[k.name], k.column.cast("double"))).alias(k.name)
            for k in plain
        ])
        frames.append(_long(wide, [k.name for k in plain]))
    by_column: dict[str, list[Kpi]] = {}
    for kpi in kpis:
        if kpi.agg == "count_distinct":
            by_column.setdefault(str(kpi.column), []).append(kpi)
    for group in by_column.values():
        values = df.groupBy(group[0].column.alias("__value")).agg(
            *[F.bool_or(F.coalesce(keep[k.name], F.lit(False))).alias(k.name) for k in group]
        ).where(F.col("__value").isNotNull())
        wide = values.agg(
            *[F.count_if(F.col(k.name)).cast("double").alias(k.name) for k in group]
        )
        frames.append(_long(wide, [k.name for k in group]))
    return reduce(DataFrame.unionByName, frames)


def _long(wide: DataFrame, names: list[str]) -> DataFrame:
    return wide.unpivot([], [F.col(f"`{n}`") for n in names], "kpi", "value")


def _in_year(column: str, type_name: str, year: int) -> Column:
    """A range and not `year(column)`, so that files and row groups can be skipped."""
    since = F.col(column) >= F.lit(f"{year:04d}-01-01").cast(type_name)
    if year == 9999:
        return since
    return since & (F.col(column) < F.lit(f"{year + 1:04d}-01-01").cast(type_name))


def closest_column(title: str, columns: Sequence[str]) -> str | None:
    """Column that a title means: the same letters and digits, else one inside the other, else four
    characters in a row in common; the first such column, or none."""
    def form(name: str) -> str:
        return "".join(ch for ch in name.strip().lower() if ch.isascii() and ch.isalnum())

    wanted = form(title)
    runs = {wanted[i:i + 4] for i in range(len(wanted) - 3)}
    found: list[tuple[int, int]] = []
    for i, column in enumerate(columns):
        name = form(column)
        if not wanted or not name:
            continue
        if name == wanted:
            found.append((0, i))
        elif wanted in name or name in wanted:
            found.append((1, i))
        elif any(run in name for run in runs):
            found.append((2, i))
    return columns[min(found)[1]] if found else None


def skipped_slicers(df: DataFrame, slicers: Sequence[Slicer]) -> list[str]:
    """Titles of selected slicers that no column answers to."""
    return [s.title for s in slicers if s.values and [str(v) for v in s.values] != ["All"]
            and closest_column(s.title, df.columns) is None]


def slicer_predicate(df: DataFrame, slicers: Sequence[Slicer],
                     first_year_only: bool = False) -> Column:
    """Row filter for the selected slicer values, all of them combined.

    A title means the column that `closest_column` finds. Slicers without a selection
    (`All`), or without such a column, are skipped; `skipped_slicers` names the latter. Year
    values on a date column select by year; `first_year_only` keeps just the first one.
    """
    types = dict(df.dtypes)
    tests = [F.lit(True)]
    for slicer in slicers:
        values = [str(v) for v in slicer.values]
        column = closest_column(slicer.title, df.columns)
        if column is None or not values or values == ["All"]:
            continue
        dated = types[column].startswith(("date", "timestamp"))
        if dated and all(v.isdigit() and len(v) == 4 for v in values):
            years = sorted({int(v) for v in (values[:1] if first_year_only else values)})
            in_years = [_in_year(column, types[column], y) for y in years]
            tests.append(reduce(lambda a, b: a | b, in_years))
        elif len(values) == 1:
            tests.append(F.col(column) == values[0])
        else:
            tests.append(F.col(column).isin(values))
    return reduce(lambda a, b: a & b, tests)


def group_measures(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in measures.items()])


def top_k(df: DataFrame, measure: str, ties: list[str], k: int = 10) -> DataFrame:
    """Largest `k` rows; ends in a per-partition heap, not in a full sort."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *[F.col(t) for t in ties]).limit(k)


def first_value_or_null(spark, query: str, strict: bool = False) -> DataFrame:
    """Scalar of a query as one row `(value)`, null when the query has no row."""
    df = spark.sql(query)
    if len(df.columns) != 1:
        raise ValueError(f"Scalar query must have exactly one column, got {df.columns}")
    if strict and df.limit(2).count() > 1:
        raise ValueError("Scalar query returned more than one row")
    first = df.toDF("value").select(F.col("value").cast("double")).limit(1)
    return first.agg(F.max("value").alias("value"))
