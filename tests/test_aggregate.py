import pytest
from pyspark.sql import functions as F

from tallymark.operators.aggregate import (
    Kpi, Slicer, batch_kpis, column_aggregates, first_value_or_null, slicer_predicate, top_k,
)


@pytest.fixture
def fact(spark):
    return spark.sql("""SELECT * FROM VALUES
        (1, DATE'2023-05-01', 'North', 10.0), (2, DATE'2024-01-01', 'South', 20.0),
        (3, DATE'2024-06-01', 'North', CAST(NULL AS DOUBLE)), (4, DATE'2022-06-01', "O'Hara", 7.0)
        AS t(id, sale_date, region, sales)""")


def test_column_aggregates_skip_bad_text(spark):
    df = spark.createDataFrame([("5", "x"), ("7", "y"), ("1,000", "z"), (None, None)], "a string, b string")
    r = column_aggregates(df, {"A": ["sum", "count", "avg", "min", "max"], "b": ["sum", "avg"]}).first()
    assert (r.A_sum, r.A_count, r.A_avg, r.A_min, r.A_max) == (12.0, 2.0, 6.0, 5.0, 7.0)
    assert (r.b_sum, r.b_avg) == (0.0, None)
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert column_aggregates(nan, {"x": ["sum"]}).first()[0] == 1.0
    with pytest.raises(ValueError):
        column_aggregates(df, {"a": ["median"]})
    with pytest.raises(KeyError):
        column_aggregates(df, {"nothing": ["sum"]})


def test_batch_is_one_scan_without_expand(spark, fact, tmp_path):
    path = str(tmp_path / "fact")
    fact.write.parquet(path)
    df = spark.read.parquet(path)
    out = batch_kpis(df, [
        Kpi("all", "sum", F.col("sales")), Kpi("y24", "sum", F.col("sales"), F.year("sale_date") == 2024),
        Kpi("n", "count", F.col("sales")), Kpi("regions", "count_distinct", F.col("region")),
        Kpi("regions24", "count_distinct", F.col("region"), F.year("sale_date") == 2024),
        Kpi("none", "sum", F.col("sales"), F.col("id") > 99), Kpi("avg0", "avg", F.col("sales"), F.col("id") > 99)])
    assert {r.kpi: r.value for r in out.collect()} == {
        "all": 37.0, "y24": 20.0, "n": 3.0, "regions": 3.0, "regions24": 2.0, "none": 0.0, "avg0": None}
    plan = batch_kpis(df, [Kpi("a", "sum", F.col("sales")), Kpi("b", "avg", F.col("sales"))]
                      )._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("slicers, ids", [
    ([Slicer("Sale Date", ["2024"])], {2, 3}),
    ([Slicer("sale_date", ["2024", "2022"])], {2, 3, 4}),
    ([Slicer("Region", ["O'Hara"])], {4}),
    ([Slicer("Region", ["North", "South"]), Slicer("Sale Date", ["2024"])], {2, 3}),
    ([Slicer("Region", ["All"]), Slicer("Unknown", ["x"]), Slicer("Region", [])], {1, 2, 3, 4}),
])
def test_slicers(fact, slicers, ids):
    assert {r.id for r in fact.where(slicer_predicate(fact, slicers)).collect()} == ids


def test_first_year_only(fact):
    kept = fact.where(slicer_predicate(fact, [Slicer("sale date", ["2024", "2022"])], first_year_only=True))
    assert {r.id for r in kept.collect()} == {2, 3}


def test_scalars(spark, fact):
    fact.createOrReplaceTempView("fact_for_scalars")
    value = lambda q, **k: first_value_or_null(spark, q, **k).first().value
    assert value("SELECT count(*) FROM fact_for_scalars") == 4.0
    assert value("SELECT sales FROM fact_for_scalars WHERE id > 99") is None
    assert value("SELECT sales FROM fact_for_scalars WHERE id = 3") is None
    with pytest.raises(ValueError, match="exactly one column"):
        value("SELECT id, sales FROM fact_for_scalars")
    with pytest.raises(ValueError, match="more than one row"):
        value("SELECT id FROM fact_for_scalars", strict=True)


def test_top_k_needs_no_full_sort(fact):
    top = top_k(fact, "sales", ["id"], 2)
    assert [r.id for r in top.collect()] == [2, 1]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
