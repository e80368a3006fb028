import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions.compare import relative_difference
from tallymark.operators import align


def sales(spark, n=60):
    return spark.createDataFrame([(f"r{i}", 2020 + i % 3, float(i * 100 + 50)) for i in range(n)],
                                 "region string, year int, sales double")


def shown(df):
    return df.select("Region", "Year", F.concat(F.lit("$"), F.col("sales").cast("string")).alias(" Sales "))


@pytest.mark.parametrize("mode", [dict(duplicates="flag"), dict(duplicates="occurrence"),
                                  dict(align="positional")])
def test_a_dataset_agrees_with_itself(spark, mode):
    df = sales(spark)
    cells = align.reconcile(shown(df), df, ["Region", "Year"], ["Sales"], **mode).collect()
    assert len(cells) == 60 and all(c.passed for c in cells)


def test_k_changed_cells_are_k_failures(spark):
    df = sales(spark)
    changed = df.withColumn("sales", F.when(F.col("region").isin("r3", "r7", "r9"), F.col("sales") * 2)
                            .otherwise(F.col("sales")))
    cells = align.reconcile(shown(changed).orderBy(F.rand(1)), df, ["Region", "Year"], ["Sales"])
    failed = [c for c in cells.collect() if not c.passed]
    assert sorted(c.region for c in failed) == ["r3", "r7", "r9"]
    assert {c.status for c in failed} == {"mismatch"}


def test_missing_rows_and_null_keys(spark):
    pub = spark.createDataFrame([("a", "1"), (None, "2"), ("c", "–")], "k string, v string")
    src = spark.createDataFrame([("a", 1.0), (None, 2.0), ("d", 4.0)], "k string, v double")
    got = {(c.k, c.status) for c in align.reconcile(pub, src, ["k"], ["v"]).collect()}
    assert got == {("a", "match"), (None, "match"), ("c", "missing_in_source"), ("d", "missing_in_published")}


def test_null_policies(spark):
    pub = spark.createDataFrame([("a", "–"), ("b", "1")], "k string, v string")
    src = spark.createDataFrame([("a", None), ("b", float("nan"))], "k string, v double")
    match = {c.k: (c.status, c.passed) for c in align.reconcile(pub, src, ["k"], ["v"]).collect()}
    assert match == {"a": ("both_null", True), "b": ("source_null", False)}
    strict = align.reconcile(pub, src, ["k"], ["v"], null_policy="strict").collect()
    assert not any(c.passed for c in strict)


def test_repeated_keys_pair_by_value(spark):
    pub = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "9")], "k string, v string")
    src = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("b", 9.0), ("b", 9.0)], "k string, v double")
    got = sorted((c.k, c.occurrence, c.status) for c in align.reconcile(pub, src, ["k"], ["v"]).collect())
    assert got == [("a", 1, "match"), ("a", 2, "mismatch"), ("a", 3, "missing_in_source"),
                   ("b", 1, "match"), ("b", 2, "missing_in_published")]
    flagged = align.reconcile(pub, src, ["k"], ["v"], duplicates="flag").collect()
    assert {(c.k, c.status) for c in flagged} == {("a", "duplicate_key"), ("b", "duplicate_key")}


def test_hot_key_matches_brute_force(spark, monkeypatch):
    """A third of the rows share one key; the numbering is cut into small pieces."""
    monkeypatch.setattr(align, "position_in_group", lambda *a, **k: __import__(
        "tallymark.operators.ranking", fromlist=["x"]).position_in_group(*a, group_rows=8, **k))
    rng = random.Random(5)
    pub = [("hot" if i % 3 == 0 else f"k{rng.randrange(30)}", rng.randrange(6)) for i in range(300)]
    src = [("hot" if i % 3 == 0 else f"k{rng.randrange(30)}", rng.randrange(6)) for i in range(310)]
    cells = align.reconcile(
        spark.createDataFrame([(k, str(v)) for k, v in pub], "k string, v string"),
        spark.createDataFrame([(k, float(v)) for k, v in src], "k string, v double"), ["k"], ["v"]).collect()
    for key in {k for k, _ in pub} | {k for k, _ in src}:
        a = sorted(v for k, v in pub if k == key)
        b = sorted(v for k, v in src if k == key)
        got = sorted((c for c in cells if c.k == key), key=lambda c: c.occurrence)
        assert len(got) == max(len(a), len(b))
        assert [c.published for c in got] == a + [None] * (len(got) - len(a))
        assert [c.source for c in got] == b + [None] * (len(got) - len(b))


def test_positional_keys_are_not_compared(spark):
    pub = spark.createDataFrame([("v", "b", "2"), ("v", "a", "1")], "visual string, k string, m string")
    src = spark.createDataFrame([("v", "x", 1.0), ("v", "y", 2.0), ("w", "z", 3.0)],
                                "visual string, k string, m double")
    got = sorted((c.visual, c.position, c.status) for c in align.reconcile(
        pub, src, ["k"], ["m"], visual=["visual"], align="positional").collect())
    assert got == [("v", 1, "match"), ("v", 2, "match"), ("w", 1, "missing_in_published")]


def test_unknown_columns_name_the_available_ones(spark):
    df = sales(spark)
    with pytest.raises(ValueError, match="Column 'profit' not found in published data"):
        align.reconcile(shown(df), df, ["Region"], ["Profit"])
    with pytest.raises(ValueError):
        align.reconcile(shown(df), df, ["Region"], ["Sales"], align="loose")


def test_summary_counts_and_lines_keep_every_failure(spark):
    cells = spark.createDataFrame([("v", i, i % 2 == 0) for i in range(20)] + [("ok", 1, True)],
                                  "visual string, i int, passed boolean")
    got = {r.visual: r for r in align.summarise_cells(cells, ["visual"]).collect()}
    assert (got["v"].cells, got["v"].failed_cells, got["v"].passed) == (20, 10, False)
    assert got["ok"].passed
    lines = align.failure_lines(cells, ["visual"], F.format_string("cell %02d", "i")).collect()
    assert sorted(r.detail for r in lines) == [f"cell {i:02d}" for i in range(1, 20, 2)]


def test_positional_rows_of_a_null_visual_meet(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "b", 2.0), ("v", "a", 3.0)],
                               "visual string, k string, m double")
    cells = align.reconcile(df, df, ["k"], ["m"], visual=["visual"], align="positional").collect()
    assert [c.status for c in cells] == ["match"] * 3


def test_columns_are_looked_up_without_blanks_around(spark):
    cells = spark.createDataFrame([(1, "Sales\t"), (1, "\u00a0Region")], "visual_id int, col_name string")
    required = spark.createDataFrame([(1, " sales"), (1, "region\u00a0"), (1, "tax")],
                                     "visual_id int, required_col string")
    assert [r.required_col for r in align.missing_columns(cells, required).collect()] == ["tax"]


def test_row_counts(spark):
    a = spark.createDataFrame([("v",), ("v",), ("w",)], "visual string")
    b = spark.createDataFrame([("v",), ("v",), ("x",)], "visual string")
    got = {r.visual: (r.published_rows, r.source_rows, r.passed) for r in
           align.row_counts(a, b, ["visual"]).collect()}
    assert got == {"v": (2, 2, True), "w": (1, 0, False), "x": (0, 1, False)}


def test_keyed_alignment_is_one_shuffle(spark):
    df = sales(spark)
    cells = align.reconcile(shown(df), df, ["Region", "Year"], ["Sales"], duplicates="flag")
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "Python" not in plan


def test_relative_difference_is_floored_at_one(spark):
    row = spark.range(1).select(relative_difference(F.lit(0.2), F.lit(0.1)).alias("d")).first()
    assert abs(row.d - 0.1) < 1e-12
