"""Slicer filters in spec rows: one scan of a source serves all combinations that specs ask for.

Equal filters are one predicate. A row of the source has a signature, the predicates it passes, found by
looking up its values; a spec has a mask, the predicates it needs. The source is aggregated by the set of
masks that a row's signature contains, and these sets roll up to their masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import match_form
from tallymark.operators.aggregate import AGGREGATES

#: Characters in a row that a slicer title and a column must share at least.
RUN = 4
ALL = "All"


def column_table(spark, frames: list[DataFrame]) -> DataFrame:
    """(source_no, columns): the columns of every source as an array of (place, name, dated)."""
    rows = [(n, [(i, c, kind.startswith(("date", "timestamp"))) for i, (c, kind) in enumerate(df.dtypes)])
            for n, df in enumerate(frames)]
    return spark.createDataFrame(
        rows, "source_no int, columns array<struct<place int, name string, dated boolean>>")


def closest(title: Column, columns: Column) -> Column:
    """The column struct that a title means: the same letters and digits, else one inside the other, else
    `RUN` characters in a row in common; the first of the best ones, or null."""
    wanted = match_form(title)

    def level(name: Column) -> Column:
        starts = F.when(F.length(wanted) >= RUN, F.sequence(F.lit(1), F.length(wanted) - (RUN - 1)))
        shares = F.exists(F.coalesce(starts, F.array().cast("array<int>")),
                          lambda i: F.contains(name, F.substr(wanted, i, F.lit(RUN))))
        return F.when((wanted == "") | (name == ""), None).when(wanted == name, 0).when(
            F.contains(wanted, name) | F.contains(name, wanted), 1).when(shares, 2)

    ranked = F.transform(columns, lambda c: F.struct(
        level(match_form(c["name"])).alias("level"), c["place"].alias("place"), c.alias("column")))
    return F.array_min(F.filter(ranked, lambda r: r["level"].isNotNull()))["column"]


def compile_filters(filters: DataFrame, asked: DataFrame, frames: list[DataFrame],
                    first_year_only: bool = False) -> DataFrame:
    """(spec_id, source_no, title, column, by_year, values, pred) of the filters that select something.

    `filters(spec_id, title, values)` has a row per slicer, `asked(spec_id, source_no)` the source of each
    spec. Slicers without a selection, or with only `All`, are left out; `column` is null where no column
    answers to the title. Four-digit values of a date column select by year, all of them or with
    `first_year_only` the first. `pred` is equal for equal filters of one source.
    """
    chosen = filters.where((F.size("values") > 0) & (F.col("values") != F.array(F.lit(ALL)))).join(
        asked.select("spec_id", "source_no").distinct(), "spec_id")
    columns = column_table(filters.sparkSession, frames)
    titles = chosen.select("source_no", "title").distinct().join(columns, "source_no").select(
        "source_no", "title", closest(F.col("title"), F.col("columns")).alias("meant"))
    by_year = F.col("meant.dated") & F.forall("values", lambda v: v.rlike(r"^\d{4}$"))
    kept = F.when(F.col("by_year") & F.lit(first_year_only), F.slice("values", 1, 1)).otherwise(F.col("values"))
    told = chosen.join(titles, ["source_no", "title"]).select(
        "spec_id", "source_no", "title", F.col("meant.name").alias("column"),
        F.coalesce(by_year, F.lit(False)).alias("by_year"), "values"
    ).withColumn("values", F.array_sort(F.array_distinct(kept)))
    return told.withColumn("pred", F.when(F.col("column").isNotNull(), F.md5(
        F.to_json(F.struct("column", "by_year", "values")).cast("binary"))))


def skipped_filters(compiled: DataFrame) -> DataFrame:
    """(spec_id, title) of selected slicers that no column of the spec's source answers to."""
    return compiled.where(F.col("column").isNull()).select("spec_id", "title")


def spec_masks(compiled: DataFrame) -> DataFrame:
    """(spec_id, source_no, mask, preds); specs without filters are not listed."""
    return compiled.where(F.col("pred").isNotNull()).groupBy("spec_id", "source_no").agg(
        F.array_sort(F.collect_set("pred")).alias("preds")
    ).withColumn("mask", F.md5(F.array_join("preds", ",").cast("binary")))


def _mask_lookup(masks: DataFrame) -> DataFrame:
    """(pred, own, joint, open): what a row that passes a predicate learns about the masks that need it.

    `own` is the mask of this predicate alone, `joint` whether masks of several predicates need it. Each of those
    masks is in `open` of one predicate only, the one that fewest such masks need, so that rows which pass
    a common predicate are not held against all masks that contain it.
    """
    alone = masks.where(F.size("preds") == 1).select(F.get("preds", F.lit(0)).alias("pred"), F.col("mask_no").alias("own"))
    members = masks.where(F.size("preds") > 1).select("mask_no", "preds", F.explode("preds").alias("pred"))
    common = members.groupBy("pred").agg(F.count(F.lit(1)).alias("n"))
    rarest = members.join(common, "pred").groupBy("mask_no").agg(
        F.min_by(F.struct("pred", "preds"), F.struct("n", "pred")).alias("least")).select(
        F.col("least.pred").alias("pred"), F.struct("mask_no", "least.preds").alias("one"))
    told = alone.unionByName(common.select("pred", F.lit(True).alias("joint")), allowMissingColumns=True).unionByName(
        rarest, allowMissingColumns=True)
    return told.groupBy("pred").agg(F.max("own").alias("own"), F.coalesce(F.bool_or("joint"), F.lit(False)).alias("joint"),
                                    F.collect_list("one").alias("open"))


def with_signature(df: DataFrame, preds: DataFrame | None, used: list[tuple[str, bool]],
                   masks: DataFrame | None = None) -> DataFrame:
    """`df` with `__preds`, the predicates that a row passes, in order, and with `masks(mask_no, preds)` also
    `__masks`, the masks whose predicates it passes all; rows with the same masks have them in the same order.

    `preds(column, by_year, values, pred)` are those of this source and `used` their columns. A value is
    read in the type of its column, so every column costs one equality join with its distinct values, which
    Spark broadcasts where they are few.
    """
    types, names = dict(df.dtypes), ["preds"]
    if masks is not None and used:
        names += ["own", "joint", "open"]
        preds = preds.join(_mask_lookup(masks), "pred")
    for i, (column, by_year) in enumerate(used):
        kind, own = ("int", F.year(f"`{column}`")) if by_year else (types[column], F.col(f"`{column}`"))
        gathered = {"preds": F.col("pred"), "own": F.col("own"), "joint": F.when(F.col("joint"), F.col("pred")),
                    "open": F.col("open")}
        lists = {n: F.collect_list(gathered[n]) for n in names}
        lookup = preds.where((F.col("column") == column) & (F.col("by_year") == by_year)).withColumn(
            f"__value{i}", F.explode(F.array_distinct(F.transform("values", lambda v: v.try_cast(kind))))
        ).where(F.col(f"__value{i}").isNotNull()).groupBy(f"__value{i}").agg(*[
            F.array_sort(F.flatten(c) if n == "open" else c).alias(f"__{n}{i}") for n, c in lists.items()])
        df = df.join(lookup, own == F.col(f"__value{i}"), "left").drop(f"__value{i}")

    def all_of(name: str, kind: str) -> Column:
        none = F.array().cast(f"array<{kind}>")
        return F.concat(*[F.coalesce(f"__{name}{i}", none) for i in range(len(used))]) if used else none

    signed = {"__preds": F.array_sort(all_of("preds", "string"))}
    if masks is not None:
        none = F.array().cast("array<bigint>")
        signed["__masks"] = none
        if used:
            opened = all_of("open", "struct<mask_no: bigint, preds: array<string>>")
            whole = F.filter(opened, lambda m: F.size(F.array_except(m["preds"], all_of("joint", "string"))) == 0)
            signed["__masks"] = F.concat(all_of("own", "bigint"), F.when(
                F.size(opened) > 0, F.transform(whole, lambda m: m["mask_no"])).otherwise(none))
    return df.withColumns(signed).drop(*[f"__{n}{i}" for n in names for i in range(len(used))])


def masked_figures(df: DataFrame, preds: DataFrame | None, masks: DataFrame | None, used: list[tuple[str, bool]],
                   wanted: list[tuple[str, str, Column]]) -> DataFrame:
    """(mask, column, agg, value) of every wanted figure of a source, for each mask that some row passes.

    `masks(mask, mask_no, preds)` are numbered; without filters there is one mask. `wanted` has (column, aggregate,
    values) with the values as numbers, or as they are for distinct counts. All figures come from one scan: rows are
    aggregated by the masks they pass and, once more for each distinct count, by these and the value.
    """
    for _, agg, _ in wanted:
        if agg not in AGGREGATES:
            raise ValueError(f"Unsupported aggregate '{agg}'. Use one of {AGGREGATES}")
    numbers = {c: v for c, agg, v in wanted if agg != "count_distinct"}
    places = {c: i for i, c in enumerate(numbers)}
    null = F.lit(None).cast("double")
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    pieces = {f"{name}{places[c]}": (name, f"__v{places[c]}") for c, agg, _ in wanted if c in places and agg != "count_distinct"
              for name in (("sum", "count") if agg in ("avg", "mean") else (agg,))}
    merged = [merge[name](out).alias(out) for out, (name, _) in pieces.items()]

    # A row comes once for each distinct count, the last time with its numbers; values of one type share a column.
    counted = {c: v for c, agg, v in wanted if agg == "count_distinct"}
    kinds = [f.dataType for f in df.select(*[v.alias(f"__d{j}") for j, v in enumerate(counted.values())]).schema]
    slots = {kind: f"__d{s}" for s, kind in enumerate(dict.fromkeys(kinds))}
    nothing = {**{f"__v{i}": null for i in places.values()}, **{d: F.lit(None).cast(kind) for kind, d in slots.items()}}
    parts = [{"__part": F.lit(j), slots[kind]: v} for j, (v, kind) in enumerate(zip(counted.values(), kinds))]
    parts = parts or [{"__part": F.lit(0)}]
    parts[-1].update({f"__v{places[c]}": F.nanvl(v.cast("double"), null) for c, v in numbers.items()})
    signed = with_signature(df, preds, used, masks) if used else df.withColumn("__masks", F.array().cast("array<bigint>"))
    rows = signed.select("__masks", F.inline(F.array(*[
        F.struct(*[{**nothing, **part}[name].alias(name) for name in ("__part", *nothing)]) for part in parts])))

    def grouped(df: DataFrame, by: str, aggregates: list[Column]) -> DataFrame:
        keys = [by, "__part", *slots.values()]
        return df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()

    values = grouped(rows, "__masks", [getattr(F, name)(v).alias(out) for out, (name, v) in pieces.items()])
    # Every value once per set of masks, then once per mask; all rows belong to the empty mask, which has no number.
    one = F.lit(None).cast("bigint")
    if used:
        values = grouped(values.withColumn("mask_no", F.explode(F.concat("__masks", F.array(one)))), "mask_no", merged)
    else:
        values = values.withColumn("mask_no", one)
    figures = values.groupBy("mask_no").agg(*merged, *[
        F.count(F.when(F.col("__part") == j, F.col(slots[kind]))).cast("double").alias(f"distinct{j}")
        for j, kind in enumerate(kinds)])

    def value(c: str, agg: str) -> Column:
        if agg == "count_distinct":
            return F.col(f"distinct{list(counted).index(c)}")
        i = places[c]
        if agg == "sum":
            return F.coalesce(F.col(f"sum{i}"), F.lit(0.0))
        if agg in ("avg", "mean"):
            return F.try_divide(F.col(f"sum{i}"), F.col(f"count{i}"))
        return F.col(f"{agg}{i}").cast("double")

    named = figures.join(masks.select("mask", "mask_no"), "mask_no", "left") if used else figures.withColumn("mask", F.lit(""))
    return named.select(F.coalesce("mask", F.lit("")).alias("mask"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(agg).alias("agg"), value(c, agg).alias("value")) for c, agg, _ in wanted])))
