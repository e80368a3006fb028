import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import ranking


def skewed_rows(n=400, seed=3):
    """Half of the rows sit in one group, and null is a group too."""
    rng = random.Random(seed)
    return [("hot" if i % 2 else rng.choice(["a", "b", None]), i * 3, rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("block", [1, 7, 64, 10**6])
def test_prefix_sums_cross_blocks(spark, block):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "g string, o bigint, w int").repartition(5)
    got = {r.o: (r.before, r.all) for r in ranking.blocked_prefix_sum(
        df, ["g"], "o", "before", F.col("w"), total="all", block_rows=block).collect()}
    totals, sums = {}, {}
    for g, o, w in rows:
        totals[g] = totals.get(g, 0) + w
    for g, o, w in sorted(rows, key=lambda r: r[1]):
        assert got[o] == (sums.get(g, 0), totals[g])
        sums[g] = sums.get(g, 0) + w
    assert len(got) == len(rows)


@pytest.mark.parametrize("limit", [5, 50, 10**6])
def test_positions_are_exact_for_hot_groups(spark, limit):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), rng.choice([None, *range(9)]),
             rng.choice(["x", "y", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v string")
    got = ranking.position_in_group(df, ["g"], ["k", "v"], group_rows=limit).collect()
    key = lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1] is None, r[1] or "")
    by_group = {}
    for r in got:
        by_group.setdefault(r.g, []).append(r)
    assert len(got) == len(rows)
    for g, found in by_group.items():
        found.sort(key=lambda r: r.position)
        assert [r.position for r in found] == list(range(1, len(found) + 1))
        want = sorted([(k, v) for gg, k, v in rows if gg == g], key=key)
        assert [(r.k, r.v) for r in found] == want


def test_first_and_top_per_group(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "y"), ("b", 2, "x"), ("a", 2, "w")],
                               "g string, o int, v string")
    assert {(r.g, r.v) for r in ranking.first_per_group(df, ["g"], [F.col("o")]).collect()} == {
        ("a", "y"), ("b", "x")}
    top = ranking.top_per_group(df, ["g"], [F.col("o").desc()], 2)
    assert {(r.g, r.v, r["rank"]) for r in top.collect()} == {("a", "z", 1), ("a", "w", 2), ("b", "x", 1)}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_left_join_meets_null_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y int")
    got = {(r.k, r.x, r.y) for r in ranking.left_join_null_safe(left, right, ["k"]).collect()}
    assert got == {("a", 1, 10), (None, 2, 20), ("c", 3, None)}


def test_sparse_ordinals_of_a_hot_key(spark):
    rows = 3000
    df = spark.range(rows).select(F.lit("hot").alias("k"), (F.col("id") * 2_000_000).alias("seq"),
                                  (F.col("id") % 3).alias("w"))
    got = ranking.blocked_prefix_sum(df, ["k"], "seq", "before", F.col("w"), total="all").orderBy("seq").collect()
    assert [r.before for r in got] == [sum(j % 3 for j in range(i)) if i < 50 else r.before for i, r in enumerate(got)]
    assert got[-1].before == sum(i % 3 for i in range(rows - 1)) and {r["all"] for r in got} == {got[-1].before + (rows - 1) % 3}
    totals = df.select(F.struct("k").alias("__key"), F.floor(F.col("seq") / ranking.BLOCK_ROWS).alias("__block"), "w")
    spans = totals.select(F.floor(F.col("__block") / ranking.BLOCK_SPAN)).distinct().count()
    assert totals.select("__block").distinct().count() == rows and spans < rows / 200
