"""Exact quantiles of weighted values, by counts of distinct values over ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import by_value
from tallymark.session import cut


def quantiles(values: DataFrame, probabilities: list[float]) -> dict[int, np.ndarray]:
    """Quantiles of each series of `values(series, value, weight)`, as `np.quantile` has them of all rows.

    A value counts as often as its weight says. Equal values become one row, rows are dealt by ranges, and a
    task looks up the ranks that fall into its range. The driver gets a row per range and series, and two per
    quantile. Series without rows are left out.
    """
    counted = values.groupBy("series", "value").agg(F.sum("weight").alias("n")).where("n > 0")
    placed = cut(counted.repartitionByRange("series", "value").withColumn("part", F.spark_partition_id()))
    before, total = {}, {}
    for series, part, n in placed.groupBy("series", "part").agg(F.sum("n")).orderBy("series", "part").collect():
        before[series, part] = total.get(series, 0)
        total[series] = total.get(series, 0) + n
    place = {s: np.array(probabilities) * (n - 1) for s, n in total.items()}
    ranks = {s: np.unique(np.concatenate([np.floor(p), np.minimum(np.floor(p) + 1, total[s] - 1)])).astype(np.int64)
             for s, p in place.items()}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: dict[int, int] = {}
        for batch in batches:
            series, value, n, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for s in np.unique(series).tolist():
                own = np.flatnonzero(series == s)
                first = before[s, int(part[own[0]])] + passed.get(s, 0)
                ends = first + np.cumsum(n[own])
                passed[s] = passed.get(s, 0) + int(n[own].sum())
                asked = ranks[s][(ranks[s] >= first) & (ranks[s] < ends[-1])]
                found = value[own][np.searchsorted(ends, asked, side="right")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s] * len(asked), pa.int32()), pa.array(asked), pa.array(found)],
                    names=["series", "rank", "value"])

    at = {(r["series"], r["rank"]): r["value"] for r in placed.sortWithinPartitions("series", "value").mapInArrow(
        look_up, "series int, rank bigint, value double").collect()}

    def between(series: int, p: float) -> float:
        low = int(np.floor(p))
        a, b, share = at[series, low], at[series, min(low + 1, total[series] - 1)], p - low
        return b - (b - a) * (1 - share) if share >= 0.5 else a + (b - a) * share

    return {s: np.array([between(s, float(p)) for p in place[s]]) for s in total}


by_value(__name__)
