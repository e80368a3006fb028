"""Positions and running totals that never put one hot group into one task.

A plain window partitioned by the group is a single task per group. Here a group
is cut into ordered blocks: rows are ranked inside their block, and the block
totals (a small table) carry the count of everything before the block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import cut

BLOCK_ROWS = 1 << 20
BLOCK_SPAN = 1 << 10


def left_join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; the key columns of `left` are kept.

    The keys travel as one struct: structs with null fields are equal to each other, and
    the join stays a plain equi-join.
    """
    found = right.select(
        F.struct(*keys).alias("__key"), *[c for c in right.columns if c not in keys])
    return left.withColumn("__key", F.struct(*keys)).join(found, "__key", "left").drop("__key")


def semi_join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` whose keys, nulls included, occur in `right`."""
    wanted = right.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]
    return left.join(wanted, reduce(lambda a, b: a & b, same), "left_semi")


def blocked_prefix_sum(
    df: DataFrame, by: list[str], ordinal: str, out: str, weight: Column | None = None,
    total: str | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exclusive running sum of `weight` (default 1) in `ordinal` order per group.

    `ordinal` is a whole number, unique in its group, so a block of consecutive
    ordinals has at most `block_rows` rows, however large the group is. `total` names a
    column for the sum over the whole group. Rows are shuffled once, by group and block;
    what `carry_blocks` makes of the block totals is joined on the same partitioning.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    blocked = df.withColumns({
        "__key": F.struct(*by), "__block": F.floor(F.col(ordinal) / block_rows),
        "__weight": weight,
    })
    block = ["__key", "__block"]
    totals = blocked.groupBy(*block).agg(F.sum("__weight").alias("__total"))
    carried = carry_blocks(totals, sums={"__total": "__carried"},
                           totals={"__total": total} if total else {})
    inside = Window.partitionBy(*block).orderBy(ordinal).rowsBetween(
        Window.unboundedPreceding, -1)
    local = blocked.withColumn("__local", F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    return (
        local.join(carried, block)
        .withColumn(out, F.col("__carried") + F.col("__local"))
        .drop("__key", "__block", "__weight", "__local", "__carried")
    )


def running_sums(df: DataFrame, by: list[str], ordinal: str, sums: dict[str, str],
                 totals: dict[str, str] = {}, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inclusive running sums of several whole-number columns, as `blocked_prefix_sum` has of one.

    `sums` maps columns to their running sums, `totals` to their sums over the whole group.
    """
    blocked = df.withColumns({"__key": F.struct(*by), "__block": F.floor(F.col(ordinal) / block_rows)})
    block = ["__key", "__block"]
    sizes = blocked.groupBy(*block).agg(*[F.sum(c).alias(c) for c in {**sums, **totals}])
    carried = carry_blocks(sizes, sums={c: f"__before_{c}" for c in sums}, totals=totals)
    inside = Window.partitionBy(*block).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({f"__in_{c}": F.sum(c).over(inside) for c in sums}).join(carried, block)
    return local.withColumns({
        out: F.col(f"__before_{c}") + F.col(f"__in_{c}") for c, out in sums.items()
    }).drop(*block, *[f"__{k}_{c}" for c in sums for k in ("before", "in")])


def carry_blocks(blocks: DataFrame, sums: dict[str, str], maxima: dict[str, str] = {},
                 totals: dict[str, str] = {}, span: int = BLOCK_SPAN) -> DataFrame:
    """What comes before each block of a key: sums (0 before the first) and maxima (null there).

    `blocks(__key, __block, ...)` has a row per block; the dicts map its columns to results, `totals` to
    sums over the whole key. Sparse ordinals can give a key as many blocks as it has rows, so blocks
    are carried in spans of `span` block numbers, which are shared by tasks, and only the spans of a
    key meet in one window.
    """
    spanned = blocks.withColumn("__span", F.floor(F.col("__block") / span))
    group = ["__key", "__span"]
    earlier = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("__key").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("__key")
    spans = spanned.groupBy(*group).agg(
        *[F.sum(c).alias(c) for c in {*sums, *totals}], *[F.max(c).alias(c) for c in maxima],
    ).select(
        *group, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__far_{c}") for c in sums],
        *[F.max(c).over(before).alias(f"__far_{c}") for c in maxima],
        *[F.sum(c).over(everything).alias(name) for c, name in totals.items()])
    near = spanned.select(
        *group, "__block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__near_{c}") for c in sums],
        *[F.max(c).over(earlier).alias(f"__near_{c}") for c in maxima])
    return near.join(spans, group).select(
        "__key", "__block",
        *[(F.col(f"__far_{c}") + F.col(f"__near_{c}")).alias(name) for c, name in sums.items()],
        *[F.greatest(f"__far_{c}", f"__near_{c}").alias(name) for c, name in maxima.items()],
        *totals.values())


def position_in_group(
    df: DataFrame, group: list[str], order: list[str], out: str = "position",
    group_rows: int = BLOCK_ROWS, sizes: DataFrame | None = None,
) -> DataFrame:
    """1-based position of every row of a group in `order`, nulls last.

    The columns of `df` must be `group + order`, so equal rows are interchangeable. Groups
    of up to `group_rows` rows are numbered by a window. Larger ones are cut out first, by
    their row counts (`sizes(*group, n)` when the caller has them), and spread over tasks
    by `_position_in_hot_groups`; their number is bounded by rows / `group_rows`.
    """
    if sizes is None:
        sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    hot = cut(sizes.where(F.col("n") > group_rows).select(*group))
    window = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    if hot.isEmpty():
        return df.withColumn(out, F.row_number().over(window).cast("bigint"))
    marked = left_join_null_safe(df, hot.withColumn("__hot", F.lit(True)), group)
    usual = marked.where(F.col("__hot").isNull()).drop("__hot")
    large = marked.where(F.col("__hot")).drop("__hot")
    return usual.withColumn(out, F.row_number().over(window).cast("bigint")).unionByName(
        _position_in_hot_groups(large, group, order, out, group_rows))


def _position_in_hot_groups(
    df: DataFrame, group: list[str], order: list[str], out: str, run_rows: int
) -> DataFrame:
    """Positions where equal rows travel as one row with a count.

    The distinct rows are range partitioned, so a group is shared by many tasks. Range
    bounds are sampled anew by each run, hence the durable cut before they are used twice.
    """
    runs = df.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("__n"))
    ordering = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    placed = cut(
        runs.repartitionByRange(*ordering)
        .withColumns({"__part": F.spark_partition_id(), "__key": F.struct(*group)})
    )
    part = ["__key", "__part"]
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = placed.groupBy(*part).agg(F.sum("__n").alias("__total")).select(
        *part, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__carried"))
    inside = Window.partitionBy(*part).orderBy(
        *[F.col(c).asc_nulls_last() for c in order]
    ).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__local", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    starts = local.join(carried, part).withColumn(
        "__first", F.col("__carried") + F.col("__local") + 1)

    def spread(rows: DataFrame, first: Column, n: Column) -> DataFrame:
        return rows.select(
            *group, *order, F.explode(F.sequence(first, first + n - 1)).alias(out)
        )

    short = spread(starts.where(F.col("__n") <= run_rows), F.col("__first"), F.col("__n"))
    # A long run of equal rows is cut into pieces that go to different tasks.
    pieces = (
        starts.where(F.col("__n") > run_rows)
        .withColumn("__piece", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / run_rows))))
        .repartition(*[F.col(c) for c in group], F.col("__first"), F.col("__piece"))
    )
    offset = F.col("__piece") * run_rows
    long = spread(
        pieces, F.col("__first") + offset,
        F.least(F.lit(run_rows).cast("bigint"), F.col("__n") - offset),
    )
    return short.unionByName(long)


def first_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row per group by an aggregate, so a hot group is combined map-side."""
    rest = [c for c in df.columns if c not in by]
    return (
        df.groupBy(*by)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """First `n` rows per group; Spark limits each group before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
