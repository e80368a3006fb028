from pyspark.sql import functions as F

from tallymark.functions.text import error_phrase
from tallymark.plans import checks, specs
from tests.test_numbers import evaluate


def test_kpi_modes_and_statuses(spark):
    cases = [  # id, sql, file, expected, is_text, raw, sql_value, file_value, status, passed
        (1, True, True, "9", False, "$10", 10.0, 99.0, "match", True),
        (2, True, True, None, False, "$10", None, 10.0, "source_null", False),
        (3, False, True, "9", False, "10", None, 10.0, "match", True),
        (4, False, False, "1000", False, "1K", None, None, "match", True),
        (5, False, False, "ab", False, "1K", None, None, "bad_expected_value", False),
        (6, False, False, "ABC", True, "x abc y", None, None, "match", True),
        (7, False, False, None, False, "12%", None, None, "extracted", True),
        (8, False, False, None, False, "n/a", None, None, "not_parsed", False),
        (9, True, False, None, False, None, 1.0, None, "not_captured", False),
        (10, True, False, None, False, "–", None, None, "both_null", True),
    ]
    kpis = spark.createDataFrame([(c[0], "p", f"t{c[0]}", c[1], c[2], c[3], c[4], 0.01) for c in cases],
                                 "spec_id int, page string, visual_title string, has_sql boolean, has_file boolean, "
                                 "expected_value string, is_text boolean, tolerance double")
    shown = spark.createDataFrame(
        [("p", f"t{c[0]}", n, raw) for c in cases if c[5] is not None for n, raw in ((1, c[5]), (2, "77"))],
        "page string, visual_title string, ordinal int, raw string")
    values = spark.createDataFrame([(c[0], c[6], c[7]) for c in cases],
                                   "spec_id int, sql_value double, file_value double")
    got = {r.spec_id: (r.status, r.passed) for r in checks.validate_kpis(kpis, shown, values).collect()}
    assert got == {c[0]: (c[8], c[9]) for c in cases}


def test_blank_pages_mean_the_current_or_any_page(spark):
    kpis = spark.createDataFrame(
        [(1, None, "a"), (2, "", "a"), (3, " ", "b"), (4, "Q", "b"), (5, "P", "b")],
        "spec_id int, page string, visual_title string").selectExpr(
        "*", "false AS has_sql", "false AS has_file", "string(null) AS expected_value", "false AS is_text",
        "0.01D AS tolerance")
    shown = spark.createDataFrame([("P", "a", 1, "1"), ("P", "a", 2, "x"), ("Q", "b", 3, "2")],
                                  "page string, visual_title string, ordinal int, raw string")
    values = spark.createDataFrame([], "spec_id int, sql_value double, file_value double")

    def statuses(**current):
        rows = checks.validate_kpis(kpis, shown, values, **current).collect()
        assert len(rows) == 5
        return {r.spec_id: r.status for r in rows}

    assert statuses() == {1: "extracted", 2: "extracted", 3: "extracted", 4: "extracted", 5: "not_captured"}
    assert statuses(current_page="P") == {
        1: "extracted", 2: "extracted", 3: "not_captured", 4: "extracted", 5: "not_captured"}
    there = spark.createDataFrame([("P", "a")], "page string, title string")
    wanted = kpis.select("spec_id", "page", "visual_title", F.lit("KPI").alias("kind"))
    assert {(r.spec_id, r.reason) for r in checks.missing_visuals(wanted, there).collect()} == {
        (3, "visual_not_found"), (4, "page_not_found"), (5, "visual_not_found")}
    slicers = spark.createDataFrame([("P", 2, "Year", ["2024"])],
                                    "page string, ordinal int, slicer_title string, values array<string>")
    asked = spark.createDataFrame([("", "Year", "2024\u00a0"), (None, "Year", "2024")],
                                  "page string, slicer_title string, expected_value string")
    assert {r.status for r in checks.filter_state(asked, slicers).collect()} == {"match"}


def test_tiers(spark):
    cases = [("auto", True, True, 5, 5, "dom"), ("auto", True, True, 0, 5, "api"), ("", True, True, 0, 0, "source"),
             ("auto", False, False, 0, 0, "source_unavailable"), ("dom", True, True, 0, 5, "dom_failed"),
             ("api", False, True, 5, 5, "api_unavailable"), ("API", True, True, 5, 0, "api_failed"),
             ("source", True, True, 5, 5, "source"), ("x", True, True, 5, 5, "unknown"), (None, True, True, 1, 0, "dom")]
    df = spark.createDataFrame(cases, "t string, a boolean, s boolean, d int, ar int, want string")
    for r in df.select("*", checks.route(*[F.col(c) for c in ("t", "a", "s", "d", "ar")]).alias("got")).collect():
        assert r.got == r.want, r


def test_tables(spark):
    table = spark.createDataFrame(
        [(1, "auto", False, True, True, 0.01), (2, "auto", False, True, True, 0.01), (3, "auto", False, True, False, 0.01),
         (4, "dom", False, False, True, 0.01), (5, "source", False, True, True, 0.01), (6, "auto", True, True, True, 0.01)],
        "visual_id int, tier string, has_api boolean, has_source boolean, has_columns boolean, tolerance double")
    cell = "visual_id int, row_key string, col_no int, col_name string, "
    dom = spark.createDataFrame([(1, "a", 0, "m", "$5"), (1, "b", 0, "m", "6"), (2, "a", 0, "m", "5"),
                                 (3, "z", 0, "m", "x"), (4, "a", 0, "m", "5")], cell + "raw string")
    api = spark.createDataFrame([(6, "a", 0, "m", "8")], cell + "raw string")
    source = spark.createDataFrame([(1, "a", 0, "m", 5.0), (1, "b", 0, "m", 6.0), (2, "a", 0, "m", 9.0), (2, "b", 0, "m", 1.0),
                                    (3, "q", 0, "m", 1.0), (6, "a", 0, "m", 8.0)], cell + "value double")
    got = {r.visual_id: (r.tier_used, r.cells, r.failed_cells, r.passed)
           for r in checks.validate_tables(table, dom, api, source).collect()}
    assert got == {1: ("dom", 2, 0, True), 2: ("dom", 2, 2, False), 3: ("dom", 0, 0, True), 4: ("dom", 0, 0, False),
                   5: ("source", 0, 0, False), 6: ("api", 1, 0, True)}


def test_health(spark):
    shown = spark.createDataFrame([("P", "a"), ("P", "b"), ("Q", "c")], "page string, title string")
    wanted = spark.createDataFrame([(1, "P", "a", "KPI"), (2, "p", "a", "KPI"), (3, "P", "z", "Table"), (4, "", "c", "KPI"),
                                    (5, "Q", " ", "KPI"), (6, None, "a", "KPI")],
                                   "spec_id int, page string, visual_title string, kind string")
    assert {r.page for r in checks.missing_pages(wanted, shown).collect()} == {"p"}
    got = {(r.spec_id, r.reason, r.available) for r in checks.missing_visuals(wanted, shown, "P").collect()}
    assert got == {(2, "page_not_found", 0), (3, "visual_not_found", 2), (4, "visual_not_found", 2)}
    slicers = spark.createDataFrame([("P", 2, "Year", ["2023"]), ("P", 1, "Year", ["2024"])],
                                    "page string, ordinal int, slicer_title string, values array<string>")
    filters = spark.createDataFrame([("P", "Year", "2024"), ("P", "Region", "All"), ("P", "", "x")],
                                    "page string, slicer_title string, expected_value string")
    assert {(r.slicer_title, r.status) for r in checks.filter_state(filters, slicers).collect()} == {
        ("Year", "match"), ("Region", "not_found")}
    banners = ["fine", "x Access denied", "Something went wrong: Access denied"]
    assert evaluate(spark, banners, error_phrase) == [None, "Access denied", "Access denied"]


def test_sources_are_read_until_the_first_row(spark):
    got = {r.source: r.has_rows for r in checks.source_health(
        {"some": spark.range(5), "none": spark.range(5).where("id > 9")}).collect()}
    assert got == {"some": True, "none": False}


def test_lint(spark):
    kpis = spark.createDataFrame([(1, "t", "SELECT 1", None, None), (2, "", None, "c", None), (3, "t", " ", "", "5"),
                                  (4, "t", None, None, None)],
                                 "spec_id int, visual_title string, sql_query string, file_column string, expected_value string")
    tables = spark.createDataFrame([(5, "t", ["k"], ["c"]), (6, None, [], None)],
                                   "spec_id int, visual_title string, join_keys array<string>, compare_cols array<string>")
    assert {(r.spec_id, r.issue) for r in specs.lint(kpis, tables).collect()} == {
        (2, "visual_title is empty"), (4, "no source to compare with"), (6, "visual_title is empty"),
        (6, "no join_keys"), (6, "no compare_cols")}


def test_specs_without_a_page_come_first(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "")], "spec_id int, page string")
    assert [r.spec_id for r in specs.in_page_order(df).collect()] == [2, 4, 3, 1]


def test_verdict_summary_has_a_total(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "page string, passed boolean")
    assert {(r.page, r.total, r.passed, r.failed) for r in checks.verdict_summary(df).collect()} == {
        ("a", 2, 1, 1), ("b", 1, 1, 0), (None, 3, 2, 1)}
