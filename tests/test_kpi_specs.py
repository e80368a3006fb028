from pyspark.sql import functions as F

from tallymark.operators.aggregate import Slicer, closest_column, slicer_predicate
from tallymark.plans import filters, kpis, sqltext

SPEC = "spec_id bigint, origin string, source string, column string, agg string"
FILTER = "spec_id bigint, title string, values array<string>"


def fact(spark):
    return spark.sql("""SELECT id, CAST(id % 5 AS INT) AS code, concat('r', id % 3) AS region_name, id * 1.5D AS sales,
        CASE WHEN id % 4 = 0 THEN NULL ELSE date_add(DATE'2022-12-01', CAST(id * 20 AS INT)) END AS sale_date,
        CAST(id % 2 AS STRING) AS `Odd Text` FROM range(60)""")


def test_titles_mean_the_same_columns_as_on_the_driver(spark):
    columns = ["order_date", "region_name", "sales", "date", "Net Sales", "%%", "né"]
    titles = ["Date", "Region", "Order Date!", "Saleable", "zz", "", "net-sales", "x", "order", "sa", "é", None]
    frame = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    table = filters.column_table(spark, [frame])
    found = spark.createDataFrame([(t,) for t in titles], "title string").join(table).select(
        "title", filters.closest(F.col("title"), F.col("columns"))["name"].alias("name")).collect()
    assert {r.title: r.name for r in found} == {t: closest_column(t or "", columns) for t in titles}


def test_values_of_filtered_specs(spark):
    """Every mix of slicers gives what a filter and an aggregate of its own give."""
    df = fact(spark)
    slicers = {
        1: [], 2: [("Region", ["r1"])], 3: [("Region", ["r1", "r2"]), ("Code", ["3"])], 4: [("Sale date", ["2023"])],
        5: [("Sale date", ["2024", "2023"]), ("Region", ["r0"])], 6: [("Region", ["All"]), ("Nothing", ["x"])],
        7: [("Region", ["not there"])], 8: [("Code", ["abc"])], 9: [("sale_date", ["2023-06-09", "2023"])],
        10: [("odd text", ["1"]), ("Region", [])], 11: [("Region", ["r2", "r1"]), ("Code", ["3"])], 12: [("Code", ["03", "3"])]}
    wanted = [("sales", "sum"), ("Sales ", "AVG"), ("id", "count"), ("sales", "min"), ("id", "max"), ("code", "count_distinct"),
              ("region_name", "count_distinct"), ("odd text", "mean"), ("sale_date", "count")]
    rows = [(s * 100 + i, "file" if s % 2 else "sql", " Fact", c, agg) for s in slicers for i, (c, agg) in enumerate(wanted)]
    rows += [(1, "sql", "fact", "nope", "sum"), (2, "sql", "other", "id", "sum"), (3, "sql", "fact", "id", "median")]
    asked = [(s * 100 + i, t, v) for s, own in slicers.items() for i in range(len(wanted)) for t, v in own]
    got = {r.spec_id: r.sql_value if r.file_value is None else r.file_value for r in kpis.spec_values(
        spark.createDataFrame(rows, SPEC), {"sql": {"FACT": df}, "file": {"fact": df}},
        spark.createDataFrame(asked, FILTER)).collect()}
    assert set(got) == {r[0] for r in rows[:-3]}
    by_hand = {8: "code = -1", 9: "sale_date = DATE'2023-06-09'", 12: "code = 3"}  # values read in the type of the column
    for s, own in slicers.items():
        kept = df.where(by_hand.get(s) or slicer_predicate(df, [Slicer(t, v) for t, v in own]))
        r = kept.selectExpr("sum(sales) s", "avg(sales) a", "count(id) n", "min(sales) lo", "max(id) hi", "count(DISTINCT code) c",
                            "count(DISTINCT region_name) g", "avg(CAST(`Odd Text` AS DOUBLE)) o").first()
        want = [r.s or 0.0, r.a, r.n, r.lo, r.hi, r.c, r.g, r.o, 0.0]
        assert [got[s * 100 + i] for i in range(len(wanted))] == want, s


def test_first_year_and_skipped(spark):
    df = fact(spark)
    asked = spark.createDataFrame([(1, 0)], "spec_id bigint, source_no int")
    given = spark.createDataFrame([(1, "Sale date", ["2024", "2023"]), (1, "zz", ["a"]), (1, "yy", ["All"])], FILTER)
    compiled = filters.compile_filters(given, asked, [df], first_year_only=True)
    assert [(r.column, r["values"]) for r in compiled.where("by_year").collect()] == [("sale_date", ["2024"])]
    assert [tuple(r) for r in filters.skipped_filters(compiled).collect()] == [(1, "zz")]


def test_one_scan_for_all_filters(spark, tmp_path):
    fact(spark).drop("Odd Text").write.parquet(str(tmp_path / "f"))
    df = spark.read.parquet(str(tmp_path / "f"))
    preds = spark.createDataFrame([("code", False, ["1"], "p"), ("code", False, ["1", "2"], "q")],
                                  "column string, by_year boolean, values array<string>, pred string")
    signed = filters.with_signature(df, preds, [("code", False)])
    assert signed._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {tuple(r["__preds"]) for r in signed.collect()} == {(), ("p", "q"), ("q",)}


def test_one_scan_for_all_figures(spark, tmp_path):
    """Distinct counts of two columns included; masks share predicates, within a column and across columns."""
    rows = [(i, i % 4 if i % 9 else None, "xyz"[i % 3] if i % 7 else None, i % 5 * 0.5 if i % 8 else None) for i in range(240)]
    spark.createDataFrame(rows, "id bigint, code int, kind string, size double").write.parquet(str(tmp_path / "f"))
    df = spark.read.parquet(str(tmp_path / "f"))
    tests = {"a": ("code", ["1", "2"]), "b": ("code", ["2", "3"]), "c": ("kind", ["x"]), "d": ("kind", ["x", "y"]), "e": ("size", ["1.0"]),
             "f": ("code", ["9"])}
    preds = spark.createDataFrame([(c, False, v, p) for p, (c, v) in tests.items()],
                                  "column string, by_year boolean, values array<string>, pred string")
    needs = ["a", "b", "c", "ab", "ac", "bd", "abd", "cd", "ace", "bde", "de", "f", "af"]
    masks = spark.createDataFrame([(m, 7 * i, list(m)) for i, m in enumerate(needs)], "mask string, mask_no bigint, preds array<string>")
    used = [("code", False), ("kind", False), ("size", False)]
    wanted = [("id", "count_distinct", F.col("id")), ("id", "max", F.col("id")), ("kind", "count_distinct", F.col("kind")),
              ("size", "avg", F.col("size")), ("size", "count", F.col("size")), ("size", "count_distinct", F.col("size"))]
    figures = filters.masked_figures(df, preds, masks, used, wanted)
    assert figures._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    want, names = {}, ["id", "code", "kind", "size"]
    for mask in ["", *needs]:
        own = [r for r in (dict(zip(names, row)) for row in rows) if all(
            r[c] is not None and str(r[c]) in v for c, v in (tests[p] for p in mask))]
        sizes = [r["size"] for r in own if r["size"] is not None]
        found = [len({r["id"] for r in own}), max((r["id"] for r in own), default=None), len({r["kind"] for r in own} - {None}),
                 sum(sizes) / len(sizes) if sizes else None, len(sizes), len(set(sizes))]
        want.update({(mask, c, agg): v for (c, agg, _), v in zip(wanted, found) if own})
    assert {(r.mask, r.column, r.agg): r.value for r in figures.collect()} == want
    assert len(want) == 12 * len(wanted)
    plain = filters.masked_figures(df, None, None, [], wanted)
    assert {(r.mask, r.column, r.agg): r.value for r in plain.collect()} == {k: v for k, v in want.items() if k[0] == ""}


def test_query_texts(spark):
    views = {"fact_texts": fact(spark)}
    texts = ["SELECT sum(id) FROM fact_texts", "select SUM(id) from fact_texts ;", "SELECT id FROM fact_texts WHERE id < 0",
             "SELECT max(id) FROM fact_texts WHERE id < 0", "SELECT id, code FROM fact_texts", "SELECT 1 / 0", "SELEC 1", "",
             "SELECT id FROM fact_texts ORDER BY id DESC", "SELECT 'five'", "DROP VIEW fact_texts", None, "SELECT x FROM fact_texts",
             "WITH w AS (SELECT 3 AS v) SELECT v FROM w"]
    specs = spark.createDataFrame([(t,) for t in [*texts, *texts]], "sql_query string")
    got = {r.sql_query: (r.value, r.error) for r in sqltext.query_values(specs, views).collect()}
    assert got == {
        texts[0]: (1770.0, None), texts[1]: (1770.0, None), texts[2]: (None, None), texts[3]: (None, None),
        texts[4]: (None, "NOT_ONE_COLUMN"), texts[5]: (None, "DIVIDE_BY_ZERO"), texts[6]: (None, "PARSE_SYNTAX_ERROR"),
        texts[8]: (59.0, None), texts[9]: (None, "CAST_INVALID_INPUT"), texts[10]: (None, "PARSE_SYNTAX_ERROR"),
        texts[12]: (None, "UNRESOLVED_COLUMN"), texts[13]: (3.0, None)}
    assert spark.sql("SELECT count(*) FROM fact_texts").first()[0] == 60


def test_many_texts_are_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(sqltext, "BATCH", 4)
    specs = spark.createDataFrame([(f"SELECT {i} + CAST('{'x' if i == 7 else 1}' AS INT)",) for i in range(11)], "sql_query string")
    got = sqltext.query_values(specs).collect()
    assert sorted(r.value for r in got if r.error is None) == [i + 1 for i in range(11) if i != 7]
    assert [r.error for r in got if r.error] == ["CAST_INVALID_INPUT"]
