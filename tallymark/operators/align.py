"""Alignment of a published dataset with its source, and the cell verdicts.

Both sides become one tagged union that is aggregated by the alignment key. That
is a single shuffle with map-side combining, takes null keys as they are, and has
no full outer join that a hot key could unbalance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.compare import passes, relative_difference, value_status
from tallymark.functions.numbers import display_number, plain_number, strip
from tallymark.functions.text import normalise_header
from tallymark.operators.ranking import (
    position_in_group, semi_join_null_safe,
)
from tallymark.session import cut

ALIGNMENTS = ("keyed", "positional")
DUPLICATES = ("occurrence", "flag")


def _number(df: DataFrame, column: str, displayed: bool) -> Column:
    if dict(df.dtypes)[column] == "string":
        parsed = display_number(F.col(column)) if displayed else plain_number(F.col(column))
    else:
        parsed = F.col(column).cast("double")
    return parsed if displayed else F.nanvl(parsed, F.lit(None).cast("double"))


def _side(df: DataFrame, keys: list[Column], measures: list[str], displayed: bool) -> DataFrame:
    return df.select(*keys, *[_number(df, m, displayed).alias(m) for m in measures])


def _shared_keys(published: DataFrame, source: DataFrame, keys: list[str]) -> list[Column]:
    """Keys that both sides can be compared on: native where the types agree, else as text."""
    left, right = dict(published.dtypes), dict(source.dtypes)
    return [
        F.col(k) if left[k] == right[k] != "string" else strip(F.col(k).cast("string")).alias(k)
        for k in keys
    ]


def _combine(tagged: DataFrame, keys: list[str], measures: list[str],
             more: list[Column] = ()) -> DataFrame:
    """One row per key of the tagged union: both values of each measure and row counts."""
    is_pub = F.col("__pub")
    pairs = list(more)
    for m in measures:
        pairs.append(F.max(F.when(is_pub, F.col(m))).alias(f"published_{m}"))
        pairs.append(F.max(F.when(~is_pub, F.col(m))).alias(f"source_{m}"))
    return tagged.groupBy(*keys).agg(
        *pairs, F.count_if(is_pub).alias("n_published"), F.count_if(~is_pub).alias("n_source")
    )


def align_keyed(published: DataFrame, source: DataFrame, keys: list[str],
                measures: list[str], duplicates: str = "occurrence") -> DataFrame:
    """Rows of both sides on equal keys; keys of different types are compared as text.

    With `occurrence` the k-th smallest row of a repeated key meets the k-th
    smallest of the other side; the repeated keys are found first and only their rows
    are numbered. `flag` is for keys that are meant to be unique (a
    grouped source): it costs no second pass and leaves repeated keys to be
    reported as such.
    """
    if duplicates not in DUPLICATES:
        raise ValueError(f"duplicates must be one of {DUPLICATES}")
    shared = _shared_keys(published, source, keys)
    pub, src = _side(published, shared, measures, True), _side(source, shared, measures, False)
    tagged = pub.withColumn("__pub", F.lit(True)).unionByName(
        src.withColumn("__pub", F.lit(False)))
    combined = _combine(tagged, keys, measures).withColumn(
        "occurrence", F.lit(1).cast("bigint"))
    if duplicates == "flag":
        return combined
    repeated = cut(combined.where((F.col("n_published") > 1) | (F.col("n_source") > 1)).select(
        *keys, "n_published", "n_source"))
    if repeated.isEmpty():
        return combined
    rows = semi_join_null_safe(tagged, repeated, keys)
    sizes = repeated.select(F.lit(True).alias("__pub"), *keys, F.col("n_published").alias("n")
                            ).unionByName(repeated.select(
        F.lit(False).alias("__pub"), *keys, F.col("n_source").alias("n")))
    numbered = position_in_group(rows, ["__pub", *keys], measures, "occurrence", sizes=sizes)
    again = _combine(numbered, [*keys, "occurrence"], measures)
    once = (F.col("n_published") <= 1) & (F.col("n_source") <= 1)
    return combined.where(once).unionByName(again)


def align_positional(published: DataFrame, source: DataFrame, visual: list[str],
                     keys: list[str], measures: list[str]) -> DataFrame:
    """Row i of one side with row i of the other, each sorted by its own keys.

    Keys keep their native type and are not compared. Rows beyond the shorter side
    come out with one side missing.
    """
    shared = [*_shared_keys(published, source, visual), *[F.col(k) for k in keys]]
    pub, src = _side(published, shared, measures, True), _side(source, shared, measures, False)
    order = [*keys, *measures]
    # The null keys of a visual meet in an aggregation, as in the keyed form; a join would part them.
    placed = position_in_group(pub, visual, order).withColumn("__pub", F.lit(True)).unionByName(
        position_in_group(src, visual, order).withColumn("__pub", F.lit(False)))
    shown_keys = [F.max(F.when(F.col("__pub"), F.col(k).cast("string"))).alias(k) for k in keys]
    return _combine(placed, [*visual, "position"], measures, shown_keys)


def compare_cells(aligned: DataFrame, measures: list[str], tolerance: Column,
                  null_policy: str = "match") -> DataFrame:
    """One row per aligned row and measure, with status and verdict."""
    ids = [c for c in aligned.columns
           if c not in {f"{s}_{m}" for s in ("published", "source") for m in measures}]
    cells = aligned.withColumn("__tolerance", tolerance).select(
        *ids, "__tolerance",
        F.inline(F.array(*[
            F.struct(
                F.lit(m).alias("measure"),
                F.col(f"published_{m}").alias("published"),
                F.col(f"source_{m}").alias("source"),
            ) for m in measures
        ])),
    )
    status = (
        F.when(F.col("n_published") == 0, F.lit("missing_in_published"))
        .when(F.col("n_source") == 0, F.lit("missing_in_source"))
        .when((F.col("n_published") > 1) | (F.col("n_source") > 1), F.lit("duplicate_key"))
        .otherwise(value_status(
            F.col("published"), F.col("source"), F.col("__tolerance"), null_policy))
    )
    return (
        cells.withColumn("rel_diff", relative_difference(F.col("published"), F.col("source")))
        .withColumn("status", status)
        .withColumn("passed", passes(F.col("status"), null_policy))
        .drop("n_published", "n_source", "__tolerance")
    )


def reconcile(published: DataFrame, source: DataFrame, keys: list[str], measures: list[str],
              tolerance: float = 0.01, *, visual: list[str] = (), align: str = "keyed",
              null_policy: str = "match", duplicates: str = "occurrence") -> DataFrame:
    """Cell verdicts of a published dataset against its source.

    `visual` columns, when given, belong to the key and keep many visuals in one job.
    """
    if align not in ALIGNMENTS:
        raise ValueError(f"align must be one of {ALIGNMENTS}")
    published, source = normalise_columns(published), normalise_columns(source)
    keys, measures, visual = ([c.lower() for c in x] for x in (keys, measures, visual))
    require_columns(published, [*visual, *keys, *measures], "published")
    require_columns(source, [*visual, *keys, *measures], "source")
    if align == "positional":
        aligned = align_positional(published, source, visual, keys, measures)
    else:
        aligned = align_keyed(published, source, [*visual, *keys], measures, duplicates)
    return compare_cells(aligned, measures, F.lit(tolerance), null_policy)


def normalise_columns(df: DataFrame, space_to_underscore: bool = False) -> DataFrame:
    names = [c.strip().lower() for c in df.columns]
    return df.toDF(*[n.replace(" ", "_") if space_to_underscore else n for n in names])


def require_columns(df: DataFrame, needed: list[str], side: str) -> None:
    for column in needed:
        if column not in df.columns:
            raise ValueError(
                f"Column '{column}' not found in {side} data. Available: {df.columns}"
            )


def missing_columns(cells: DataFrame, required: DataFrame) -> DataFrame:
    """Required columns a captured visual lacks, in long form.

    `cells(visual_id, col_name)`, `required(visual_id, required_col)`.
    """
    present = cells.select(
        "visual_id", normalise_header(F.col("col_name")).alias("required_col")
    ).distinct()
    lacking = required.select(
        "visual_id", normalise_header(F.col("required_col")).alias("required_col")
    ).join(present, ["visual_id", "required_col"], "left_anti")
    available = present.groupBy("visual_id").agg(
        F.array_join(F.array_sort(F.collect_set("required_col")), ", ").alias("available")
    )
    return lacking.join(available, "visual_id", "left")


def row_counts(published: DataFrame, source: DataFrame, by: list[str]) -> DataFrame:
    """Rows per visual on both sides; a side without rows counts 0."""
    tagged = published.select(*by, F.lit(True).alias("__pub")).unionByName(
        source.select(*by, F.lit(False).alias("__pub"))
    )
    counts = tagged.groupBy(*by).agg(
        F.count_if(F.col("__pub")).alias("published_rows"),
        F.count_if(~F.col("__pub")).alias("source_rows"),
    )
    return counts.withColumn("passed", F.col("published_rows") == F.col("source_rows"))


def summarise_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells, failed cells and verdict per visual; `failure_lines` has what failed."""
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(~F.col("passed")).alias("failed_cells"),
    ).withColumn("passed", F.col("failed_cells") == 0)


def failure_lines(cells: DataFrame, by: list[str], detail: Column) -> DataFrame:
    """`(*by, detail)`: one row for every failed cell, however many a visual has."""
    return cells.where(~F.col("passed")).select(*by, detail.alias("detail"))
