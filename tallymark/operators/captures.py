"""Captured grids, chart points and API answers, shaped into tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import vocab
from tallymark.functions.numbers import strip
from tallymark.functions.text import api_column, let, point_label, undouble
from tallymark.operators.ranking import BLOCK_ROWS, blocked_prefix_sum, left_join_null_safe, running_sums
from tallymark.operators.skew import spread_join
from tallymark.session import cut

#: Of the hashes of runs of rows: a prime, and a base for each.
MODULUS = (1 << 31) - 1
BASES = (16807, 48271, 69621)

API_BODY = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("tables", T.ArrayType(T.StructType([
            T.StructField("rows", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        ]))),
    ]))),
])


def named_cells(headers: Column, cells: Column, strict: bool = False) -> Column:
    """Header and cell by position as `(col_no, col_name, raw)`; extra cells are `col_i`.

    With `strict` a row of another width than the header gives no cells.
    """
    named = F.transform(cells, lambda v, i: F.struct(
        i.alias("col_no"),
        F.coalesce(F.nullif(F.try_element_at(headers, i + 1), F.lit("")),
                   F.concat(F.lit("col_"), i.cast("string"))).alias("col_name"),
        v.alias("raw"),
    ))
    if not strict:
        return named
    return F.when(F.size(headers) == F.size(cells), named)


def drop_empty_rows(cells: DataFrame, row_keys: list[str]) -> DataFrame:
    """Cells of rows in which at least one cell has text."""
    filled = cells.groupBy(*row_keys).agg(
        F.bool_or(F.coalesce(strip(F.col("raw")), F.lit("")) != "").alias("__filled")
    ).where("__filled").drop("__filled")
    return cells.join(filled, row_keys, "left_semi")


def grid(cells: DataFrame, row_keys: list[str], headers: list[str]) -> DataFrame:
    """Wide rows of a captured grid; rows without any text are dropped."""
    wide = cells.groupBy(*row_keys).pivot("col_name", headers).agg(F.first("raw", True))
    return wide.where(F.exists(
        F.array(*[F.col(f"`{h}`") for h in headers]), lambda x: F.coalesce(strip(x), F.lit("")) != ""
    ))


def capture_completeness(cells: DataFrame, reported: DataFrame) -> DataFrame:
    """Rows captured per visual against the row total the visual reports.

    `reported(visual_id, reported_total)`; the flag is a column and never a row.
    """
    captured = cells.select("visual_id", "row_no").distinct().groupBy("visual_id").agg(
        F.count(F.lit(1)).alias("captured_rows")
    )
    rows = F.coalesce("captured_rows", F.lit(0))
    return reported.join(captured, "visual_id", "left").select(
        "visual_id", "reported_total", rows.alias("captured_rows"),
        ((F.col("reported_total") > 0) & (rows < F.col("reported_total"))).alias("partial"),
    )


def header_lists(cells: DataFrame) -> DataFrame:
    """Headers of each visual in column order; one entry per column, not per row."""
    columns = cells.select("visual_id", "col_no", "col_name").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("col_no", "col_name")))
    return columns.groupBy("visual_id").agg(
        F.transform(ordered, lambda x: x["col_name"]).alias("headers")
    )


def drop_repeats(rows: DataFrame, visual: list[str], cells: list[str], seq: str) -> DataFrame:
    """Rows seen again on a later scroll page are dropped, the first one stays.

    Genuine duplicates look the same and go as well; `stitch_pages` keeps them.
    """
    return rows.groupBy(*visual, *cells).agg(F.min(seq).alias(seq))


def _power(base: int, exponent: Column, bits: int = 40) -> Column:
    """`base` to a whole-number power of up to `bits` bits modulo `MODULUS`, by its squares."""
    squares = F.array(*[F.struct(
        F.lit(1 << b).cast("bigint").alias("bit"), F.lit(pow(base, 1 << b, MODULUS)).cast("bigint").alias("factor"))
        for b in range(bits)])
    return F.aggregate(squares, F.lit(1).cast("bigint"), lambda acc, s: F.when(
        exponent.bitwiseAND(s["bit"]) != 0, acc * s["factor"] % MODULUS).otherwise(acc))


def stitch_pages(rows: DataFrame, visual: list[str], page: str, row: str, cells: list[str]) -> DataFrame:
    """Rows of overlapping scroll pages as one list: what a page repeats of the one before goes.

    The overlap of a page with the one before it is the longest run of rows that ends that page and begins
    this one. Rows are compared on `cells`, nulls included; repeats within a page, and repeats that are not
    at a seam, stay. `page` orders the pages of a visual and `row` the rows of a page; both may have gaps.
    `drop_repeats` is the rule without pages.

    Every end and every beginning of a page has a polynomial hash, from running sums over its rows, so a
    seam is one equality per length, and neither a page nor a visual has to be in one task. Hashes are three
    of 31 bits; two different runs of a thousand rows agree by chance once in 10^19.
    """
    every = range(len(BASES))
    lanes = {f"__h{i}": F.pmod(F.xxhash64(F.lit(i), *[
        x for c in cells for x in (F.col(c).isNull(), F.col(c))]), F.lit(MODULUS)) for i in every}
    where = [*visual, page]
    placed = cut(_placed(rows.where(F.col(row).isNotNull()), where, row))
    place, size = F.col("__place"), F.col("__size")
    largest = placed.agg(F.coalesce(F.max("__size"), F.lit(1))).first()[0]
    terms = placed.withColumns({**lanes, **{
        f"__power{i}": _power(b, place, int(largest).bit_length()) for i, b in enumerate(BASES)}}).withColumns(
        {f"__term{i}": F.col(f"__h{i}") * F.col(f"__power{i}") % MODULUS for i in every}).drop(*lanes)
    sums, totals = {f"__term{i}": f"__upto{i}" for i in every}, {f"__term{i}": f"__all{i}" for i in every}
    page_window = Window.partitionBy(*where)
    upto = page_window.orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    hashed = terms.where(size <= BLOCK_ROWS).withColumns({
        **{out: F.sum(c).over(upto) for c, out in sums.items()},
        **{out: F.sum(c).over(page_window) for c, out in totals.items()}})
    if largest > BLOCK_ROWS:
        hashed = hashed.unionByName(running_sums(terms.where(size > BLOCK_ROWS), where, "__place", sums, totals))
    hashed = cut(hashed)
    pages = placed.groupBy(*where).agg(F.max("__size").alias("__size")).withColumn(
        "__before", F.lag(page).over(Window.partitionBy(*visual).orderBy(page))).where(F.col("__before").isNotNull())
    ends = hashed.select(*visual, F.col(page).alias("__before"), (size - place).alias("__length"), *[
        F.pmod(F.col(f"__all{i}") - F.col(f"__upto{i}") + F.col(f"__term{i}"), F.lit(MODULUS)).alias(f"__end{i}")
        for i in every], *[f"__power{i}" for i in every])
    starts = spread_join(hashed.drop(*[f"__power{i}" for i in every]), pages, where, ["__place"], size="__size").select(
        *where, "__before", "__size", (place + 1).alias("__length"),
        *[(F.col(f"__upto{i}") % MODULUS).alias(f"__start{i}") for i in every])
    alike = reduce(lambda a, b: a & b, [
        F.col(f"__end{i}") == F.col(f"__start{i}") * F.col(f"__power{i}") % MODULUS for i in every])
    overlap = starts.join(ends, [*visual, "__before", "__length"]).where(alike).groupBy(*where).agg(
        F.max("__length").alias("__overlap"), F.max("__size").alias("__size"))
    return spread_join(placed, overlap, where, ["__place"], "left", size="__size").where(
        place >= F.coalesce("__overlap", F.lit(0))).select(*rows.columns)


def _placed(rows: DataFrame, where: list[str], row: str) -> DataFrame:
    """Rows with `__place`, from 0 in the order of `row`, and `__size`, the rows of their page.

    A page is a window; those of more than `BLOCK_ROWS` rows are found by their counts and go in blocks.
    """
    rows = cut(rows)
    hot = cut(rows.groupBy(*where).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BLOCK_ROWS).select(
        *where, F.lit(True).alias("__hot")))
    inside = Window.partitionBy(*where)
    counts = {"__place": (F.row_number().over(inside.orderBy(row)) - 1).cast("bigint"),
              "__size": F.count(F.lit(1)).over(inside)}
    if hot.isEmpty():
        return rows.withColumns(counts)
    marked = left_join_null_safe(rows, hot, where)
    usual = marked.where(F.col("__hot").isNull()).drop("__hot")
    large = marked.where(F.col("__hot")).drop("__hot")
    return usual.withColumns(counts).unionByName(blocked_prefix_sum(large, where, row, "__place", total="__size"))


def preview(cells: DataFrame, max_columns: int = 6, max_values: int = 4) -> DataFrame:
    """Row count and first row of each visual, from one pass over the cells.

    A row's cells are gathered first, so no array is longer than the grid is wide.
    """
    in_order = F.array_sort(F.collect_list(F.struct("col_no", "col_name", "raw")))
    rows = cells.groupBy("visual_id", "row_no").agg(
        F.slice(in_order, 1, max_columns).alias("cells"))
    first = rows.groupBy("visual_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min_by("cells", "row_no").alias("cells"))
    return first.select(
        "visual_id", "rows",
        F.array_join(F.transform("cells", lambda x: x["col_name"]), ", ").alias("columns"),
        F.array_join(F.transform(F.slice("cells", 1, max_values),
                                 lambda x: F.coalesce(x["raw"], F.lit(""))), " | ")
        .alias("first_row"),
    )


def preview_all(specs: DataFrame, cells: DataFrame) -> DataFrame:
    """Preview per configured visual; a visual without rows is not extracted."""
    return specs.join(preview(cells), "visual_id", "left").withColumn(
        "rows", F.coalesce("rows", F.lit(0))
    ).withColumn("extracted", F.col("rows") > 0)


def api_rows(responses: DataFrame) -> DataFrame:
    """Cells of captured API answers: first result, first table, cleaned names.

    `responses(visual_id, body)`; an answer that is empty at any level has no rows.
    """
    body = F.from_json("body", API_BODY)
    table = F.get(F.get(body["results"], F.lit(0))["tables"], F.lit(0))
    rows = table["rows"]
    parsed = responses.select("visual_id", rows.alias("__rows")).where(F.size("__rows") > 0)
    return parsed.select("visual_id", F.posexplode("__rows").alias("row_no", "__row")).select(
        "visual_id", "row_no", F.explode("__row").alias("__name", "raw")
    ).select("visual_id", "row_no", api_column(F.col("__name")).alias("col_name"), "raw")


def api_answers(responses: DataFrame) -> DataFrame:
    """`(visual_id, state, message, rows)` of captured API answers, one row per answer.

    `responses(visual_id, body)`. The first result's first table counts. States: `ok` with rows, `empty`
    where a level is missing or has nothing, `error` for an error body (its message or code in `message`),
    `unexpected` where a level is not the list or object it should be, `broken` for a text that is no
    JSON, `no_body` for null. `rows` has the table's rows as variants, null unless `ok`.
    """
    levels = (("$.results", "array<variant>"), ("$.results[0]", "map<string,variant>"),
              ("$.results[0].tables", "array<variant>"), ("$.results[0].tables[0]", "map<string,variant>"),
              ("$.results[0].tables[0].rows", "array<variant>"))

    def judged(json: Column) -> Column:
        def at(path: str, kind: str) -> Column:
            return F.try_variant_get(json, path, kind)

        def stands(path: str) -> Column:  # false where nothing, or a JSON null, is
            value = at(path, "variant")
            return value.isNotNull() & ~F.is_variant_null(value)

        error = stands("$.error")
        state = F.when(F.col("body").isNull(), "no_body").when(json.isNull(), "broken").when(
            at("$", "map<string,variant>").isNull(), "unexpected").when(error, "error")
        for path, kind in levels:
            state = state.when(~stands(path), "empty").when(at(path, kind).isNull(), "unexpected")
        rows = at(*levels[-1])
        message = F.coalesce(at("$.error.message", "string"), at("$.error.code", "string"), at("$.error", "string"))
        return F.struct(
            state.when(F.size(rows) == 0, "empty").otherwise("ok").alias("state"),
            F.when(error, message).alias("message"), F.when(~error & (F.size(rows) > 0), rows).alias("rows"))

    # A body is parsed once, however many levels are looked at.
    told = responses.select("visual_id", let(F.try_parse_json("body"), judged).alias("told"))
    return told.select("visual_id", "told.state", "told.message", "told.rows")


def api_cells(answers: DataFrame) -> DataFrame:
    """`(visual_id, row_no, col_name, kind, raw, number)` of the rows of `api_answers`.

    `kind` is the JSON type (`null`, `boolean`, `number`, `text`, `list`, `object`); nested values are JSON
    in `raw`, JSON nulls are null there. Rows are dealt anew before they are taken apart, so one body with
    many rows is work for many tasks. Rows that are no objects have no cells.
    """
    rows = answers.select("visual_id", F.posexplode("rows").alias("row_no", "row")).hint("rebalance")
    cells = rows.select("visual_id", "row_no", F.explode(
        F.try_variant_get("row", "$", "map<string,variant>")).alias("name", "value"))
    told = F.schema_of_variant("value")
    kind = (F.when(told == "VOID", "null").when(told == "BOOLEAN", "boolean").when(told == "STRING", "text")
            .when(told.startswith("ARRAY"), "list").when(told.startswith("OBJECT"), "object").otherwise("number"))
    return cells.select(
        "visual_id", "row_no", api_column(F.col("name")).alias("col_name"), kind.alias("kind"),
        F.col("value").cast("string").alias("raw"),
        F.when(kind == "number", F.try_variant_get("value", "$", "double")).alias("number"))


def _numbered(values: DataFrame, by: list[str], text: str, total: str | None = None) -> DataFrame:
    """Distinct texts of a group, numbered from 0 in order of first sight (`seq`)."""
    first = values.groupBy(*by, text).agg(F.min("seq").alias("seq"))
    return blocked_prefix_sum(first, by, "seq", "idx", total=total).drop("seq")


def labelled_points(labels: DataFrame) -> DataFrame:
    """Points from full labels `Category. Measure. Value.`, repeats dropped.

    `labels(visual_id, seq, label)`.
    """
    clean = labels.select("visual_id", "seq", F.trim("label").alias("label"))
    once = clean.groupBy("visual_id", "label").agg(F.min("seq").alias("seq"))
    return once.select("visual_id", "seq", point_label(F.col("label")).alias("__point")).where(
        F.col("__point").isNotNull()
    ).select("visual_id", "seq", "__point.category", "__point.measure", "__point.value")


def _axis_category(text: Column) -> Column:
    """Label of an axis tick; doubled text is halved. Null for blanks and numbers."""
    label = undouble(F.trim(text))
    return F.when((label != "") & ~label.rlike(vocab.AXIS_NUMERIC), label)


def _is_point_text(text: Column) -> Column:
    return F.length(F.trim(text)) > 1


def bars_on_axis(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """Bar i takes label i modulo the number of labels; repeated pairs are dropped.

    `bars(visual_id, seq, value)`, `ticks(visual_id, seq, text)`. Bars are numbered from 0 in the
    order of `seq`, which may have gaps; blank bars count but give no point. Labels are distinct and in order of first sight. Pairing is an equi-join on the label
    number, with no label list per visual.
    """
    named = ticks.select(
        "visual_id", "seq", _axis_category(F.col("text")).alias("category")
    ).where(F.col("category").isNotNull())
    labels = _numbered(named, ["visual_id"], "category")
    counts = named.select("visual_id", "category").distinct().groupBy("visual_id").agg(
        F.count(F.lit(1)).alias("labels"))
    numbered = blocked_prefix_sum(bars.select("visual_id", "seq", "value"), ["visual_id"], "seq", "bar")
    placed = numbered.withColumn("value", F.trim("value")).where(F.col("value") != "").join(
        counts, "visual_id"
    ).select("visual_id", "seq", "value", F.pmod("bar", "labels").alias("idx"))
    return placed.join(labels, ["visual_id", "idx"]).groupBy(
        "visual_id", "category", "value").agg(F.min("seq").alias("seq"))


def text_pairs(texts: DataFrame) -> DataFrame:
    """Distinct names against distinct figures of a chart, when equally many.

    `texts(visual_id, seq, text)`. Names and figures are numbered apart and meet in one
    aggregation on the number.
    """
    usable = texts.where(_is_point_text(F.col("text"))).select(
        "visual_id", "seq", F.trim("text").alias("text"))
    numeric = F.col("numeric")
    numbered = _numbered(
        usable.withColumn("numeric", F.col("text").rlike(vocab.POINT_NUMERIC)),
        ["visual_id", "numeric"], "text", total="size")
    met = numbered.groupBy("visual_id", "idx").agg(
        F.max(F.when(~numeric, F.col("text"))).alias("category"),
        F.max(F.when(numeric, F.col("text"))).alias("value"),
        F.min("size").alias("smaller"), F.max("size").alias("larger"))
    return met.where(
        F.col("category").isNotNull() & F.col("value").isNotNull()
        & (F.col("smaller") == F.col("larger"))
    ).select("visual_id", F.col("idx").alias("seq"), "category", "value")


def chart_points(labels: DataFrame, bars: DataFrame, ticks: DataFrame,
                 texts: DataFrame) -> DataFrame:
    """Points of every chart from the first of the three ways that finds any.

    Whether a way finds a point shows in its raw input, so the way is chosen per visual
    before any pairing, and each way only works on its own visuals. The inputs are read once for the
    choice and once more to write the rows of the chosen ways, which are all that is worked on.
    """
    def tagged(df: DataFrame, kind: str, text: str, shows: Column) -> DataFrame:
        return df.select("visual_id", "seq", F.col(text).cast("string").alias("text"), F.lit(kind).alias("kind"),
                         F.coalesce(shows, F.lit(False)).alias("shows"))

    inputs = (
        tagged(labels, "label", "label", point_label(F.col("label")).isNotNull())
        .unionByName(tagged(ticks, "tick", "text", _axis_category(F.col("text")).isNotNull()))
        .unionByName(tagged(bars, "bar", "value", F.trim("value") != ""))
        .unionByName(tagged(texts, "text", "text", F.lit(False))))

    def seen(kind: str) -> Column:
        return F.bool_or(F.col("shows") & (F.col("kind") == kind))

    method = F.when(seen("label"), 1).when(seen("tick") & seen("bar"), 2).otherwise(3)
    choice = inputs.groupBy("visual_id").agg(method.alias("method"))
    way = F.when(F.col("kind") == "label", 1).when(F.col("kind") == "text", 3).otherwise(2)
    used = cut(spread_join(inputs.withColumn("method", way).drop("shows"), choice,
                           ["visual_id", "method"], ["seq"], "left_semi"))

    def of(kind: str, text: str) -> DataFrame:
        return used.where(F.col("kind") == kind).select("visual_id", "seq", F.col("text").alias(text))

    def shaped(df: DataFrame, way: int) -> DataFrame:
        measure = F.col("measure") if "measure" in df.columns else F.lit(None).cast("string")
        return df.select("visual_id", F.lit(way).alias("method"), "seq", "category",
                         measure.alias("measure"), "value")

    return (
        shaped(labelled_points(of("label", "label")), 1)
        .unionByName(shaped(bars_on_axis(of("bar", "value"), of("tick", "text")), 2))
        .unionByName(shaped(text_pairs(of("text", "text")), 3))
    )
