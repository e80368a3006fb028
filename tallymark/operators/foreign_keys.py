"""Declared foreign keys, of one or several columns, checked against the rows.

A table is read once for all its keys. Rows become key tuples, are counted where they are, and the tuples
of all keys that point to one parent key meet that key in one aggregation, so nothing is joined and a hot
tuple crosses a shuffle once per task. Whole numbers stay numbers and counts stand in columns, so the
aggregation hashes and does not sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import cut

WHOLE = ("tinyint", "smallint", "int", "bigint")
NAMES = ("from_table", "from_cols", "to_table", "to_cols")


def _common_type(a: str, b: str) -> str:
    """Type in which values of both types can be compared."""
    base = {a.split("(")[0], b.split("(")[0]}
    if a == b:
        return a
    if base <= set(WHOLE):
        return "bigint"
    if base <= {*WHOLE, "decimal"}:
        scale = max(int(t.rstrip(")").split(",")[1]) for t in (a, b) if t.startswith("decimal"))
        return f"decimal(38,{scale})"
    if base <= {*WHOLE, "decimal", "float", "double"}:
        return "double"
    return "timestamp" if base <= {"date", "timestamp"} else "string"


def _tuple(columns: tuple[str, ...], types: tuple[str, ...], numbers: int, texts: int) -> list[Column]:
    """Columns `n0..`, `t0..` and `partial` of a key: whole numbers, other values as texts, a null among them."""
    typed = [(F.col(f"`{c}`").cast(t), t in WHOLE) for c, t in zip(columns, types, strict=True)]
    whole, other = [v.cast("bigint") for v, w in typed if w], [v.cast("string") for v, w in typed if not w]
    whole += [F.lit(None).cast("bigint")] * (numbers - len(whole))
    other += [F.lit(None).cast("string")] * (texts - len(other))
    return [*[v.alias(f"n{i}") for i, v in enumerate(whole)], *[v.alias(f"t{i}") for i, v in enumerate(other)],
            reduce(lambda x, y: x | y, [v.isNull() for v, _ in typed]).alias("partial")]


def _known(frames: dict[str, DataFrame], constraints: DataFrame) -> list[tuple]:
    """Declared keys of known tables and columns, with lists of equal length, in order and once each."""
    has = {name: set(df.columns) for name, df in frames.items()}
    rows = {(r[0], tuple(r[1] or ()), r[2], tuple(r[3] or ())) for r in constraints.select(*NAMES).collect()}
    return sorted(
        (a, b, c, d) for a, b, c, d in rows
        if a in has and c in has and b and len(b) == len(d) and set(b) <= has[a] and set(d) <= has[c])


def check_keys(frames: dict[str, DataFrame], constraints: DataFrame) -> DataFrame:
    """A row per declared key of `constraints(from_table, from_cols, to_table, to_cols)`:
    `(*, child_rows, unchecked_rows, orphan_rows, repeated_parent_keys, holds)`.

    Rows of the child with a null in the key are not checked, as in SQL; repeated tuples of the parent
    count once each, those with a null do not. Keys of unknown tables or columns, and lists of
    different lengths, are left out. Declared keys are a catalog and are collected; rows are not.
    """
    declared = _known(frames, constraints)
    if not declared:
        raise ValueError("no foreign key between the given tables")
    parents: dict[tuple, int] = {}
    slots: dict[int, int] = {}
    roles: list[tuple[str, int, int | None, tuple, tuple]] = []
    names = []
    for child, columns, parent, targets in declared:
        kinds = dict(frames[child].dtypes), dict(frames[parent].dtypes)
        types = tuple(_common_type(kinds[0][c], kinds[1][d]) for c, d in zip(columns, targets))
        identity = (parent, targets, types)
        if identity not in parents:
            parents[identity] = len(parents)
            roles.append((parent, parents[identity], None, targets, types))
        no = parents[identity]
        slots[no] = slots.get(no, -1) + 1
        roles.append((child, no, slots[no], columns, types))
        names.append((no, slots[no], child, list(columns), parent, list(targets)))

    whole = [sum(t in WHOLE for t in types) for *_, types in roles]
    numbers, texts = max(whole), max(len(r[4]) - w for r, w in zip(roles, whole))
    structs: dict[str, list[Column]] = {}
    for table, no, slot, columns, types in roles:
        structs.setdefault(table, []).append(F.struct(
            F.lit(no).alias("parent_no"), F.lit(slot).cast("int").alias("slot"), *_tuple(columns, types, numbers, texts)))
    tuples = reduce(DataFrame.unionByName, [
        frames[table].select(F.inline(F.array(*made))) for table, made in structs.items()])
    key = [*[f"n{i}" for i in range(numbers)], *[f"t{i}" for i in range(texts)]]
    # A count per declared key of one parent key: as many as the widest parent has.
    width = max(slots.values()) + 1
    met = tuples.groupBy("parent_no", *key, "partial").agg(
        F.count_if(F.col("slot").isNull()).alias("parent_rows"),
        *[F.count_if(F.col("slot") == i).alias(f"rows{i}") for i in range(width)])
    orphan = ~F.col("partial") & (F.col("parent_rows") == 0)
    sums = met.groupBy("parent_no").agg(
        F.count_if(~F.col("partial") & (F.col("parent_rows") > 1)).alias("repeated_parent_keys"),
        *[x for i in range(width) for x in (
            F.sum(f"rows{i}").alias(f"child{i}"), F.sum(F.when(F.col("partial"), F.col(f"rows{i}"))).alias(f"partial{i}"),
            F.sum(F.when(orphan, F.col(f"rows{i}"))).alias(f"orphan{i}"))])
    # A row per declared key: few.
    by_slot = cut(sums.select("parent_no", "repeated_parent_keys", F.inline(F.array(*[F.struct(
        F.lit(i).alias("slot"), F.col(f"child{i}").alias("child_rows"), F.col(f"partial{i}").alias("unchecked_rows"),
        F.col(f"orphan{i}").alias("orphan_rows")) for i in range(width)]))))
    every = frames[declared[0][0]].sparkSession.createDataFrame(
        names, "parent_no int, slot int, from_table string, from_cols array<string>, to_table string, "
               "to_cols array<string>")
    counts = ["child_rows", "unchecked_rows", "orphan_rows", "repeated_parent_keys"]
    return every.join(by_slot, ["parent_no", "slot"], "left").fillna(0, counts).select(
        *NAMES, *counts,
        ((F.col("orphan_rows") == 0) & (F.col("repeated_parent_keys") == 0)).alias("holds"))
