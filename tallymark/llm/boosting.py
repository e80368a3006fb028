"""Gradient-boosted trees: flat node arrays, logistic loss, monotonic constraints; sums by numpy, over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import by_value
from tallymark.llm.quantiles import quantiles
from tallymark.session import cut

#: Bins of a feature, at most 256.
BINS = 48
#: Fewer rows are not worth a task of their own, as a tree costs a pass per level.
TASK_ROWS = 10_000


@dataclass
class Trees:
    """Complete binary trees of one depth, one row per tree; node `i` has children 2i+1 and 2i+2.

    `feature` and `threshold` belong to inner nodes, `value` to the leaves in their order. A row goes
    right where its feature exceeds the threshold; nodes that are not split send all rows left.
    """
    start: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return self.start + self.value[trees, node - (2 ** self.depth - 1)].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -60, 60)))


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Features by rows: the number of edges below each value."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]).astype(np.uint8) \
        if edges else np.zeros((0, len(x)), dtype=np.uint8)


@dataclass
class Growth:
    """Trees under construction: `cut[t, node]` is the last bin that goes left, `done` trees have their values."""
    start: float
    depth: int
    unit: float
    size: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    done: int = 0

    def _nodes(self, tree: int, level: int, binned: np.ndarray) -> np.ndarray:
        node = np.zeros(binned.shape[1], dtype=np.int64)
        for first in (2 ** k - 1 for k in range(level)):
            right = np.zeros(len(node), dtype=np.int64)
            for i in range(first, 2 * first + 1):
                right[node == i] = (binned[self.feature[tree, i]] > self.cut[tree, i])[node == i]
            node = 2 * node + 1 + right
        return node - (2 ** level - 1)

    def sums(self, level: int, binned: np.ndarray, good: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gradient, curvature and weight of the next tree by (figure, node of `level`, feature, bin).

        Figures are whole multiples of `unit`, so sums do not depend on the order of rows.
        """
        score = np.full(len(good), self.start)
        for t in range(self.done):
            score += self.value[t, self._nodes(t, self.depth, binned)]
        p = 1.0 / (1.0 + np.exp(-score))
        figures = np.rint((good - weight * p) / self.unit), np.rint(
            weight * np.maximum(p * (1 - p), 1e-6) / self.unit), weight.astype(float)
        node = self._nodes(self.done, level, binned) * self.size
        made = [np.bincount(node + b, w, 2 ** level * self.size) for w in figures for b in binned]
        return np.array(made, dtype=float).reshape(3, len(binned), 2 ** level, self.size).swapaxes(1, 2)


def _learn(edges: list[np.ndarray], good: int, rows: int, sums: Callable[[Growth, int], np.ndarray],
           monotone: dict[int, int], trees: int, depth: int, rate: float, least_rows: int,
           penalty: float) -> Trees:
    """Trees level by level from `sums(growth, level)`, the sums of `Growth.sums` over all rows."""
    share = np.clip(good / rows if rows else 0.5, 1e-3, 1 - 1e-3)
    inner, size = 2 ** depth - 1, max([len(e) for e in edges], default=0) + 1
    growth = Growth(float(np.log(share / (1 - share))), depth, 2.0 ** (int(rows).bit_length() - 52), size,
                    np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), size),
                    np.zeros((trees, inner + 1)))
    threshold = np.full((trees, inner), np.inf)

    def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, low: float, high: float):
        total_g, total_h, total_n = g[0].sum(), h[0].sum(), n[0].sum()
        whole = total_g ** 2 / (total_h + penalty)
        best = (1e-6, -1, 0, 0.0, 0.0)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            left_g, left_h, left_n = (np.cumsum(a[f])[:len(e)] for a in (g, h, n))
            left = np.clip(left_g / (left_h + penalty), low, high)
            right = np.clip((total_g - left_g) / (total_h - left_h + penalty), low, high)
            gain = left_g ** 2 / (left_h + penalty) \
                + (total_g - left_g) ** 2 / (total_h - left_h + penalty) - whole
            allowed = (left_n >= least_rows) & (total_n - left_n >= least_rows)
            if f in monotone:
                allowed &= monotone[f] * (right - left) >= 0
            gain = np.where(allowed, gain, 0.0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k, left[k], right[k])
        return best

    for t in range(trees):
        bounds = {0: (-4.0, 4.0)}
        leaf_g, leaf_h = np.zeros(inner + 1), np.zeros(inner + 1)
        for level in range(depth):
            made = sums(growth, level)
            made[:2] *= growth.unit
            for at in range(2 ** level):
                node, (g, h, n) = 2 ** level - 1 + at, made[:, at]
                low, high = bounds.pop(node)
                _, f, k, left, right = best_split(g, h, n, low, high)
                sides = [(low, high), (low, high)]
                if f >= 0:
                    growth.feature[t, node], growth.cut[t, node], threshold[t, node] = f, k, edges[f][k]
                    if f in monotone:
                        middle = (left + right) / 2
                        sides = [(low, middle), (middle, high)][::monotone[f]]
                bounds[2 * node + 1], bounds[2 * node + 2] = sides
                if level == depth - 1 and len(edges):
                    for into, a in ((leaf_g, g), (leaf_h, h)):
                        own = a[max(f, 0)]
                        into[2 * at] = own[:k + 1].sum() if f >= 0 else own.sum()
                        into[2 * at + 1] = own[k + 1:].sum() if f >= 0 else 0.0
        low, high = np.array([bounds[inner + i] for i in range(inner + 1)]).T
        growth.value[t] = rate * np.clip(leaf_g / (leaf_h + penalty), low, high)
        growth.done += 1
    return Trees(growth.start, depth, growth.feature, threshold, growth.value)


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 60, depth: int = 3,
        rate: float = 0.2, bins: int = BINS, least_rows: int = 8, penalty: float = 1.0) -> Trees:
    """Fit to labels `y` (0 or 1). `monotone[f]` is +1 or -1 where the score may only rise or fall.

    A split of a constrained feature is taken only if the values of its sides are in order, and the
    middle between them bounds all leaves below, as leaf values are clipped to these bounds.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else
             np.zeros(0) for f in range(width)]
    binned, weight = _bins(x, edges), np.ones(n)
    return _learn(edges, int(y.sum()), n, lambda growth, level: growth.sums(level, binned, y, weight),
                  monotone, trees, depth, rate, least_rows, penalty)


def fit_rows(rows: DataFrame, width: int, monotone: dict[int, int], trees: int = 60, depth: int = 3,
             rate: float = 0.2, bins: int = BINS, least_rows: int = 8, penalty: float = 1.0) -> Trees:
    """`fit` over all rows of `rows(features array<double>, good bigint, weight bigint)`, by tasks.

    A row stands for `weight` rows of which `good` have the label 1. Bins lie between exact quantiles. Binned
    rows stay with the tasks, a byte per feature; for each level of a tree every task sums its rows, and one
    array per task reaches the driver, as many as the cluster has cores.
    """
    good, total, count = rows.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)),
                                  F.count(F.lit(1))).first()
    found = quantiles(rows.select("weight", F.posexplode("features").alias("series", "value")),
                      np.linspace(0, 1, bins + 1)[1:-1].tolist())
    edges = [np.unique(found.get(f, np.zeros(0))) for f in range(width)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            yield pa.RecordBatch.from_arrays([pa.array([_bins(x, edges).tobytes()], pa.binary())] + [
                pa.array([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64).tobytes()], pa.binary())
                for i in (1, 2)], names=["bins", "good", "weight"])

    parts = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, count // TASK_ROWS))
    blocks = cut(rows.select("features", "good", "weight").coalesce(parts).mapInArrow(
        pack, "bins binary, good binary, weight binary"))

    def sums(growth: Growth, level: int) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = 0.0
            for batch in batches:
                for b, g, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    made = made + growth.sums(level, np.frombuffer(b, np.uint8).reshape(width, -1),
                                              np.frombuffer(g), np.frombuffer(w))
            if isinstance(made, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary())], names=["sums"])

        made = [np.frombuffer(r[0]) for r in blocks.mapInArrow(add, "sums binary").collect()]
        return np.sum(made, axis=0).reshape(3, 2 ** level, width, growth.size)

    return _learn(edges, good, total, sums, monotone, trees, depth, rate, least_rows, penalty)


by_value(__name__)
