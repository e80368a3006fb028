"""Joins of many rows with one row per key, when one key may hold most of the rows.

Adaptive execution splits a skewed join by itself, except where the next step reuses the
join's partitioning: splitting would cost a shuffle, so it is left out. `spread_join` is for
those places; elsewhere a plain join is cheaper, as nothing is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = 16
#: Keys of up to as many rows stay whole: a task takes them at once, and their right rows are not repeated.
WHOLE_ROWS = 1 << 16


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str],
                how: str = "inner", parts: int = SPREAD, size: str | None = None) -> DataFrame:
    """Equi-join in which the rows of one key go to `parts` tasks.

    `right` is the small side, about one row per key, and is repeated `parts` times. The
    part of a left row is a hash of its `spread` columns, so a task that runs again sends
    every row to the same place. `size` names a column of both sides with the number of left rows of the
    key (null: few); then only keys of more than `WHOLE_ROWS` are spread. The right side's is dropped.
    """
    part = F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int")
    last = F.lit(parts - 1)
    if size is not None:
        large = F.coalesce(F.col(size) > WHOLE_ROWS, F.lit(False))
        part, last = F.when(large, part).otherwise(0), F.when(large, last).otherwise(0)
    repeated = right.withColumn("__part", F.explode(F.sequence(F.lit(0), last)))
    return left.withColumn("__part", part).join(
        repeated.drop(size) if size is not None else repeated, [*keys, "__part"], how
    ).drop("__part")
