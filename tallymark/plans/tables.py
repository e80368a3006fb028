"""Table checks that the spec rows drive: row keys, columns, row counts, cells and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.compare import passes, relative_difference, value_status
from tallymark.functions.numbers import comparison_detail, display_number, plain_number, strip
from tallymark.functions.text import human_label, let, normalise_header
from tallymark.operators.ranking import BLOCK_ROWS, position_in_group
from tallymark.operators.skew import WHOLE_ROWS, spread_join
from tallymark.plans.checks import route
from tallymark.session import cut

SIDES = ("dom", "api", "source")
#: How rows meet: on their keys, repeats flagged or paired in order, or by position.
KEYED, OCCURRENCE, POSITIONAL = "keyed", "occurrence", "positional"


def wide_rows(dom: DataFrame, api: DataFrame, source: DataFrame) -> DataFrame:
    """`(side, visual_id, row_no, cells)`: the cells of the three sides as rows, written once.

    A row is as wide as its table, so its list of `(col_name, raw)` stays short. Row counts, column names
    and cells are all taken from these rows.
    """
    cells = reduce(DataFrame.unionByName, [
        df.select(F.lit(side).alias("side"), "visual_id", "row_no",
                  normalise_header(F.col("col_name")).alias("col_name"), F.col("raw").cast("string").alias("raw"))
        for side, df in zip(SIDES, (dom, api, source), strict=True)])
    # Rows are sorted on the way; numbers first, as the side tells few of them apart.
    return cut(cells.groupBy("visual_id", "row_no", "side").agg(
        F.array_sort(F.collect_list(F.struct("col_name", "raw"))).alias("cells")
    ).select("side", "visual_id", "row_no", "cells"))


def plan_tables(specs: DataFrame, rows: DataFrame) -> DataFrame:
    """Specs with their tier, row counts and missing columns.

    `specs(visual_id, visual_title, visual_type, visual_index, tier, has_api, has_source, join_keys,
    compare_cols, tolerance)` and, where rows do not meet on unique keys, `align`; `rows` as `wide_rows`
    gives them. Adds `join_keys` and `compare_cols` in normal form, `align`, `tier_used`,
    `published_rows`, `source_rows`, `missing` (columns the published or the source side lacks).
    """
    side = F.col("side")
    names = F.transform("cells", lambda c: c["col_name"])
    # Rows of a table have a few layouts: they are counted first, so few lists are collected.
    layouts = rows.groupBy("visual_id", "side", names.alias("names")).agg(F.count(F.lit(1)).alias("n"))
    found = layouts.groupBy("visual_id").agg(
        *[F.sum(F.when(side == s, F.col("n")).otherwise(0)).alias(f"{s}_rows") for s in SIDES],
        *[F.array_distinct(F.flatten(F.collect_set(F.when(side == s, F.col("names"))))).alias(f"{s}_names") for s in SIDES])
    none = F.array().cast("array<string>")

    def normal(columns: str) -> Column:
        return F.transform(F.coalesce(columns, none), lambda c: normalise_header(c))

    align = F.lower(F.coalesce(F.nullif(strip(F.col("align")), F.lit("")), F.lit(KEYED))) \
        if "align" in specs.columns else F.lit(KEYED)
    planned = (
        specs.withColumn("join_keys", normal("join_keys"))
        .withColumn("compare_cols", normal("compare_cols")).withColumn("align", align)
        .join(found, "visual_id", "left")
        .fillna(0, [f"{s}_rows" for s in SIDES])
        .withColumn("tier_used", route(F.col("tier"), F.col("has_api"), F.col("has_source"),
                                       F.col("dom_rows"), F.col("api_rows")))
    )
    on = F.col("tier_used")
    needed = F.array_union("join_keys", "compare_cols")
    shown = F.when(on == "dom", F.col("dom_names")).when(on == "api", F.col("api_names"))
    lacking = F.when(on.isin("dom", "api") & F.col("has_source"), F.array_union(
        F.array_except(needed, F.coalesce(shown, none)),
        F.array_except(needed, F.coalesce("source_names", none)))).otherwise(none)
    return planned.withColumn("missing", F.sort_array(lacking)).withColumn(
        "published_rows", F.when(on == "dom", F.col("dom_rows")).when(on == "api", F.col("api_rows"))
        .otherwise(F.lit(0))).drop(*[f"{s}_names" for s in SIDES])


def _keyed_rows(rows: DataFrame, specs: DataFrame, hot: DataFrame | None) -> DataFrame:
    """`(visual_id, is_source, tolerance, align, row_key, values)` of the rows that their specs use.

    Specs are one row per visual. `hot(visual_id, n_rows)` has the visuals that are large; only their rows
    are spread, see `spread_join`.
    """
    joined = rows.join(specs.drop("n_rows"), "visual_id") if hot is None else spread_join(
        rows.join(hot, "visual_id", "left"), specs, ["visual_id"], ["side", "row_no"], size="n_rows").drop("n_rows")
    used = joined.where((F.col("side") == "source") | (F.col("side") == F.col("tier_used")))

    def cell(name: Column) -> Column:  # of repeated columns one counts
        return F.get(F.filter("cells", lambda c: c["col_name"] == name), F.lit(0))["raw"]

    def read(raw: Column) -> Column:
        return F.when(F.col("side") == "source", plain_number(raw)).otherwise(display_number(raw))

    return used.select(
        "visual_id", (F.col("side") == "source").alias("is_source"), "tolerance", "align",
        F.transform("join_keys", lambda k: strip(cell(k))).alias("row_key"),
        F.transform("compare_cols", lambda m: F.struct(
            m.alias("measure"), read(cell(m)).alias("value"), cell(m).alias("raw"))).alias("values"))


def _numbered(rows: DataFrame, large: bool) -> DataFrame:
    """Rows with their place: among those of one key, or by position among all of their side.

    Positions sort by the keys, numbers before texts and by value, missing keys last; repeats of a key, and
    rows with equal keys, by their values. Each side sorts its own keys, as it reads them. Without `large` no
    visual has so many rows that a group could pass `BLOCK_ROWS`, and groups are not counted.
    """
    def typed(key: Column) -> Column:
        number = F.when(F.col("is_source"), plain_number(key)).otherwise(display_number(key))
        return let(number, lambda n: F.struct(
            key.isNull().alias("missing"), n.isNull().alias("is_text"), n.alias("number"), key.alias("text")))

    by_position = F.col("align") == POSITIONAL
    group, none = ["visual_id", "is_source", "tolerance", "meet"], F.array().cast("array<string>")
    ready = rows.select(
        "visual_id", "is_source", "tolerance", F.when(by_position, none).otherwise(F.col("row_key")).alias("meet"),
        # Repeats of a key have no other key to sort by.
        F.transform(F.when(by_position, F.col("row_key")).otherwise(none), typed).alias("sort_key"), "values", "row_key")
    sizes = None if large else ready.select(*group, F.lit(1).cast("bigint").alias("n")).where(F.lit(False))
    return position_in_group(
        ready, group, ["sort_key", "values", "row_key"], "occurrence", sizes=sizes).drop("sort_key")


def compare_tables(plan: DataFrame, rows: DataFrame, null_policy: str = "match") -> DataFrame:
    """Cell verdicts `(visual_id, row_key, occurrence, measure, published_raw, published, source, tolerance,
    status, passed, rel_diff)` of the tables that have both sides and all columns.

    `align` of a spec says how rows meet: `keyed` on the trimmed texts of `join_keys`, where repeats are
    `duplicate_key`; `occurrence` also pairs the repeats of a key in the order of their values;
    `positional` pairs row i with row i, each side sorted by its own keys, and does not compare keys.
    All rows meet in one aggregation by visual, key and place.
    """
    usable = plan.where(
        F.col("has_source") & F.col("tier_used").isin("dom", "api") & (F.size("missing") == 0)
        & (F.size("compare_cols") > 0) & (F.size("join_keys") > 0)
    ).select("visual_id", "tier_used", "join_keys", "compare_cols", "align",
             F.col("tolerance").cast("double").alias("tolerance"),
             reduce(lambda a, b: a + b, [F.col(f"{s}_rows") for s in SIDES]).alias("n_rows"))
    placed = F.col("align").isin(OCCURRENCE, POSITIONAL)
    hot = cut(usable.where(F.col("n_rows") > WHOLE_ROWS).groupBy("visual_id").agg(F.max("n_rows").alias("n_rows")))
    # A visual may have several specs; its rows then count for each of them.
    most = usable.where(placed).groupBy("visual_id").agg(F.sum("n_rows").alias("n")).agg(F.max("n")).first()[0]
    hot = None if hot.isEmpty() else hot
    met = _keyed_rows(rows, usable.where(~placed), hot).withColumns(
        {"meet": F.col("row_key"), "occurrence": F.lit(1).cast("bigint")}).drop("align")
    if most is not None:
        met = met.unionByName(_numbered(_keyed_rows(rows, usable.where(placed), hot), most > BLOCK_ROWS))
    is_source = F.col("is_source")
    paired = met.groupBy("visual_id", "meet", "occurrence").agg(
        F.max(F.when(~is_source, F.col("values"))).alias("shown"),
        F.max(F.when(is_source, F.col("values"))).alias("given"),
        F.coalesce(F.max(F.when(~is_source, F.col("row_key"))), F.max("row_key")).alias("row_key"),
        F.max("tolerance").alias("tolerance"),
        F.count_if(~is_source).alias("n_published"), F.count_if(is_source).alias("n_source"))
    cells = paired.select(
        "visual_id", "row_key", "occurrence", "tolerance", "n_published", "n_source",
        F.inline(F.transform(F.coalesce("shown", "given"), lambda v, i: F.struct(
            v["measure"].alias("measure"), F.get("shown", i)["raw"].alias("published_raw"),
            F.get("shown", i)["value"].alias("published"), F.get("given", i)["value"].alias("source")))))
    status = (
        F.when(F.col("n_published") == 0, F.lit("missing_in_published"))
        .when(F.col("n_source") == 0, F.lit("missing_in_source"))
        .when((F.col("n_published") > 1) | (F.col("n_source") > 1), F.lit("duplicate_key"))
        .otherwise(value_status(F.col("published"), F.col("source"), F.col("tolerance"), null_policy)))
    return cells.withColumns({
        "status": status, "rel_diff": relative_difference(F.col("published"), F.col("source")),
    }).withColumn("passed", passes(F.col("status"), null_policy)).drop("n_published", "n_source")


def cell_lines(cells: DataFrame) -> DataFrame:
    """`(visual_id, row_key, measure, detail)` of every failed cell."""
    label = F.concat_ws(" | ", "row_key", F.array("measure"))
    compared = F.col("status").isin("mismatch", "published_null", "source_null", "both_null")
    line = F.when(compared, comparison_detail(
        label, F.col("published_raw"), F.col("published"), F.col("source"), F.col("rel_diff"),
        F.col("tolerance"), F.col("passed"))).otherwise(F.concat(F.lit("["), label, F.lit("] "), F.col("status")))
    return cells.where(~F.col("passed")).select("visual_id", "row_key", "measure", line.alias("detail"))


def judge_tables(plan: DataFrame, cells: DataFrame) -> DataFrame:
    """One verdict per spec: `(visual_id, label, tier_used, published_rows, source_rows, rows_equal,
    cells, failed_cells, verdict, passed)`.

    The verdict names the first thing that is wrong: the tier (an empty capture is `dom_failed` or
    `api_failed`), missing columns, unequal row counts, failed cells. Specs without columns to compare are judged by their rows.
    """
    sums = cells.groupBy("visual_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("passed")).alias("failed_cells"))
    on = F.col("tier_used")
    equal = F.col("published_rows") == F.col("source_rows")
    verdict = (
        F.when(on == "source", F.when(F.col("source_rows") > 0, "ok").otherwise("source_empty"))
        .when(~on.isin("dom", "api"), on)
        .when(~F.col("has_source"), F.lit("no_source"))
        .when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ", ")))
        .when(~equal, F.lit("row_counts_differ"))
        .when(F.col("failed_cells") > 0, F.lit("cells_differ"))
        .otherwise(F.lit("ok")))
    return (
        plan.join(sums, "visual_id", "left").fillna(0, ["cells", "failed_cells"])
        .select(
            "visual_id", human_label(F.col("visual_title"), F.col("visual_type"), F.col("visual_index"))
            .alias("label"), "tier_used", "published_rows", "source_rows", equal.alias("rows_equal"),
            "cells", "failed_cells", verdict.alias("verdict"))
        .withColumn("passed", F.col("verdict") == "ok")
    )


def check_tables(specs: DataFrame, dom: DataFrame, api: DataFrame, source: DataFrame,
                 null_policy: str = "match") -> tuple[DataFrame, DataFrame]:
    """Verdicts and cells of every table spec; see `plan_tables` for the specs.

    The cells of a side are `(visual_id, row_no, col_name, raw)`. A row counts when it has a cell,
    whichever that is.
    """
    rows = wide_rows(dom, api, source)
    plan = cut(plan_tables(specs, rows))  # a row per spec, used for the cells and the verdicts
    cells = compare_tables(plan, rows, null_policy)
    return judge_tables(plan, cells), cells
