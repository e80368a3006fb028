"""KPI checks that the spec rows drive: values of all specs from batches of aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.numbers import plain_number
from tallymark.functions.text import normalise_header
from tallymark.operators.aggregate import AGGREGATES
from tallymark.plans.checks import validate_kpis
from tallymark.plans.filters import compile_filters, masked_figures, spec_masks
from tallymark.plans.specs import filled
from tallymark.plans.sqltext import query_values
from tallymark.session import cut

ORIGINS = ("sql", "file")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _asked(specs: DataFrame, frames: list[DataFrame], names: list[tuple[str, str, int]]) -> DataFrame:
    """(spec_id, origin, column, agg, source_no) of the specs whose figure a source can give."""
    spark = specs.sparkSession
    known = spark.createDataFrame(
        [(o, name, n, c.strip().lower()) for o, name, n in names for c in dict.fromkeys(frames[n].columns)],
        "origin string, source string, source_no int, column string").distinct()
    asked = specs.select(
        "spec_id", *[normalise_header(F.col(c)).alias(c) for c in ("origin", "source", "column", "agg")])
    return asked.where(F.col("agg").isin(*AGGREGATES)).join(known, ["origin", "source", "column"]).select(
        "spec_id", "origin", "column", "agg", "source_no")


def _figure(df: DataFrame, column: str, agg: str) -> Column:
    own, kind = next((c, k) for c, k in df.dtypes if c.strip().lower() == column)
    value = F.col(f"`{own}`")
    if agg == "count_distinct" or kind.split("(")[0] in NUMERIC:
        return value
    return plain_number(value)


def spec_values(specs: DataFrame, sources: dict[str, dict[str, DataFrame]], filters: DataFrame | None = None,
                first_year_only: bool = False) -> DataFrame:
    """`(spec_id, sql_value, file_value)` of `specs(spec_id, origin, source, column, agg)`.

    `sources` has the frames of each origin (`sql`, `file`) by name; a frame given under several names is
    read once. `filters(spec_id, title, values)` are the selected slicers of the specs, see
    `compile_filters`; several slicers of a spec all hold. Specs that ask for the same figure share it, and
    all figures of a source, whatever the filters, come from one scan. What is collected are
    columns and aggregates: as many as the sources have, at most.

    A sum or count of no rows is 0, other figures of no rows are null. Specs with an unknown source, column
    or aggregate have no row.
    """
    spark = specs.sparkSession
    frames, names = [], []
    for o in ORIGINS:
        for name, df in sources.get(o, {}).items():
            if not any(df is f for f in frames):
                frames.append(df)
            names.append((o, name.strip().lower(), next(n for n, f in enumerate(frames) if df is f)))
    asked = cut(_asked(specs, frames, names))
    figures = [tuple(r) for r in asked.select("source_no", "column", "agg").distinct().collect()]
    compiled, used = None, []
    planned = asked.withColumn("mask", F.lit(""))
    if filters is not None:
        compiled = cut(compile_filters(filters, asked, frames, first_year_only).where(F.col("pred").isNotNull()))
        masks = spec_masks(compiled)
        numbered = cut(masks.select("source_no", "mask", "preds").distinct().withColumn(
            "mask_no", F.monotonically_increasing_id()))
        planned = asked.join(masks.drop("preds"), ["spec_id", "source_no"], "left").fillna("", ["mask"])
        used = [tuple(r) for r in compiled.select("source_no", "column", "by_year").distinct().collect()]
    values = []
    for n, df in enumerate(frames):
        wanted = [(c, agg, _figure(df, c, agg)) for m, c, agg in sorted(figures) if m == n]
        own, filtered = F.col("source_no") == n, sorted((c, y) for m, c, y in used if m == n)
        if wanted:
            preds, needed = (compiled.where(own).select("column", "by_year", "values", "pred").distinct(),
                             numbered.where(own).select("mask", "mask_no", "preds")) if filtered else (None, None)
            values.append(masked_figures(df, preds, needed, filtered, wanted).withColumn("source_no", F.lit(n)))
    if not values:
        return spark.createDataFrame([], "spec_id bigint, sql_value double, file_value double")
    found = planned.join(
        reduce(DataFrame.unionByName, values), ["source_no", "mask", "column", "agg"], "left")
    nothing = F.when(F.col("agg").isin("sum", "count", "count_distinct"), F.lit(0.0))
    return found.withColumn("value", F.coalesce("value", nothing)).select("spec_id", *[
        F.when(F.col("origin") == o, F.col("value")).alias(f"{o}_value") for o in ORIGINS])


def check_kpis(specs: DataFrame, captured: DataFrame, sources: dict[str, dict[str, DataFrame]],
               current_page: str | None = None, filters: DataFrame | None = None,
               views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Verdicts of `specs(spec_id, page, visual_title, origin, source, column, agg, expected_value,
    is_text, tolerance)`; see `spec_values` and `validate_kpis`. A figure that no source has is null.

    With a column `sql_query`, specs with such a text take their value from it (`query_values`, over
    `views`), whatever else they name; a text that fails gives its own spec the status `query_failed`.
    """
    origin = normalise_header(F.col("origin"))
    ready = specs.withColumns({
        f"has_{o}": F.coalesce(origin == o, F.lit(False)) for o in ORIGINS})
    values = spec_values(specs, sources, filters)
    names = ["origin", "source", "column", "agg"]
    if "sql_query" not in specs.columns:
        return validate_kpis(ready.drop(*names), captured, values, current_page)
    has_text = filled("sql_query")
    texts = cut(specs.where(has_text).select("spec_id", "sql_query"))
    answers = cut(texts.join(query_values(texts, views), "sql_query").select("spec_id", "value", "error"))
    null = F.lit(None).cast("double")
    values = values.join(answers, "spec_id", "left_anti").unionByName(
        answers.select("spec_id", F.col("value").alias("sql_value"), null.alias("file_value")))
    verdicts = validate_kpis(
        ready.withColumn("has_sql", F.col("has_sql") | has_text).drop(*names, "sql_query"),
        captured, values, current_page)
    failed = F.col("error").isNotNull() & (F.col("status") != "not_captured")
    return verdicts.join(answers.select("spec_id", "error"), "spec_id", "left").withColumns({
        "status": F.when(failed, "query_failed").otherwise(F.col("status")),
        "passed": F.col("passed") & ~failed,
        "detail": F.when(failed, F.col("error")).otherwise(F.col("detail"))}).drop("error")
