from pyspark.sql import functions as F

from tallymark.operators.aggregate import Slicer, closest_column, skipped_slicers
from tallymark.plans import tables

SPEC = ("visual_id int, visual_title string, visual_type string, visual_index int, tier string, has_api boolean, "
        "has_source boolean, join_keys array<string>, compare_cols array<string>, tolerance double")
CELL = "visual_id int, row_no int, col_name string, raw string"


def cells(spark, tables_of):
    rows = [(v, i, c, x) for v, rows in tables_of.items() for i, row in enumerate(rows) for c, x in row.items()]
    return spark.createDataFrame(rows, CELL)


def test_verdicts_from_spec_rows(spark):
    def spec(v, tier="auto", source=True, keys=("Region", "Year"), cols=("Sales",), tolerance=0.01):
        return (v, f"t{v}", "Table", 0, tier, True, source, list(keys), list(cols), tolerance)

    specs = spark.createDataFrame([
        spec(1), spec(2), spec(3, cols=("Sales", "Tax")), spec(4, "dom"), spec(5), spec(6, "api"), spec(7, source=False),
        spec(8, keys=(), cols=()), spec(9, tolerance=0.6), spec(10)], SPEC)
    row = {" region\t": "N ", "Year": "2024", "Sales": "$5", "note": "hello"}
    dom = cells(spark, {
        1: [row, row | {"Year": "2025"}], 2: [row], 3: [row], 5: [row], 7: [row], 8: [row], 9: [row],
        10: [{"Year": "2024", "Sales": "5"}, {"Year": "2025", "Sales": "6"}]})
    api = cells(spark, {6: [row | {"Sales": "7"}]})
    plain = {"region": "N", "year": "2024", "sales": "5"}
    source = cells(spark, {
        1: [plain, plain | {"year": "2025"}], 2: [plain, plain | {"year": "2025"}], 3: [plain], 4: [plain],
        5: [plain | {"sales": "9"}], 6: [plain | {"sales": "7"}], 8: [plain], 9: [plain | {"sales": "9"}],
        10: [{"year": "2024", "sales": "5"}, {"year": "2025", "sales": "6"}]})
    verdicts, found = tables.check_tables(specs, dom, api, source)
    got = {r.visual_id: (r.verdict, r.passed) for r in verdicts.collect()}
    assert got == {1: ("ok", True), 2: ("row_counts_differ", False), 3: ("missing: tax", False),
                   4: ("dom_failed", False), 5: ("cells_differ", False), 6: ("ok", True), 7: ("no_source", False),
                   8: ("ok", True), 9: ("ok", True), 10: ("missing: region", False)}
    lines = {r.visual_id: r.detail for r in tables.cell_lines(found).where(F.col("visual_id") == 5).collect()}
    assert lines == {5: "[N | 2024 | sales] failed: shown $5, read as 5.0000, expected 9.0000, "
                        "off by 44.4444% of at most 1.00%"}


def test_slicer_titles_mean_the_closest_column(spark):
    columns = ["order_date", "region_name", "sales", "date"]
    assert [closest_column(t, columns) for t in ("Date", "Region", "Order Date!", "Saleable", "zz", "")] == [
        "date", "region_name", "order_date", "sales", None, None]
    df = spark.createDataFrame([("a",)], "region_name string")
    assert skipped_slicers(df, [Slicer("Region", ["a"]), Slicer("zz", ["a"]), Slicer("yy", ["All"])]) == ["zz"]


def test_ways_to_meet(spark):
    """Repeats of a key pair in the order of their values, positions in the order of typed keys; parts may be missing."""
    def spec(v, align, keys=("Key",), tolerance=0.01):
        return (v, f"t{v}", "Table", 0, "dom", True, True, list(keys), ["Sales"], tolerance, align)

    specs = spark.createDataFrame(
        [spec(1, "occurrence"), spec(2, "positional"), spec(3, None), spec(4, " Positional ", ("Key", "Other"), 0.5)],
        SPEC + ", align string")

    def side(*rows):
        return [dict(zip(("Key", "Sales", "Other"), r)) for r in rows]

    dom = cells(spark, {
        1: side(("a", "$9"), ("a", "$10"), ("b", "1"), (None, "2"), ("c", "3")),
        2: side(("10", "30"), ("9", "20"), ("$1,100", "40"), ("x", "50"), (None, "60")),
        3: side(("a", "1"), ("a", "1"), ("b", "2")),
        4: side(("k", "5", "2"), ("k", "6", "10"))})
    source = cells(spark, {
        1: side(("a", "10"), ("a", "9.01"), ("b", "1"), (None, "2"), ("d", "3")),
        2: side(("9", "20"), ("1100", "40"), ("10", "31"), ("x", "50")),
        3: side(("a", "1"), ("b", "2")),
        4: side(("k", "9", "10"), ("k", "5", "2"))})
    found = tables.check_tables(specs, dom, dom.limit(0), source)[1].collect()
    got = sorted((r.visual_id, r.row_key[0] or "", r.occurrence, r.published, r.source, r.status) for r in found)
    assert got == sorted([
        (1, "a", 1, 9.0, 9.01, "match"), (1, "a", 2, 10.0, 10.0, "match"), (1, "b", 1, 1.0, 1.0, "match"),
        (1, "", 1, 2.0, 2.0, "match"), (1, "c", 1, 3.0, None, "missing_in_source"), (1, "d", 1, None, 3.0, "missing_in_published"),
        (2, "9", 1, 20.0, 20.0, "match"), (2, "10", 2, 30.0, 31.0, "mismatch"), (2, "$1,100", 3, 40.0, 40.0, "match"),
        (2, "x", 4, 50.0, 50.0, "match"), (2, "", 5, 60.0, None, "missing_in_source"),
        (3, "a", 1, 1.0, 1.0, "duplicate_key"), (3, "b", 1, 2.0, 2.0, "match"),
        (4, "k", 1, 5.0, 5.0, "match"), (4, "k", 2, 6.0, 9.0, "match")])


def test_each_input_is_read_once(spark, tmp_path):
    cells(spark, {1: [{"K": "a", "S": "1"}]}).write.parquet(str(tmp_path / "cells"))
    given = spark.read.parquet(str(tmp_path / "cells"))
    specs = spark.createDataFrame([(1, "t", "Table", 0, "dom", True, True, ["K"], ["S"], 0.1)], SPEC)
    rows = tables.wide_rows(given, given, given)
    plan = tables.plan_tables(specs, rows)
    text = tables.judge_tables(plan, tables.compare_tables(plan, rows))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in text and text.count("Exchange hashpartitioning") <= 8


def test_specs_are_planned_once_and_large_visuals_agree(spark, monkeypatch):
    """Layouts are counted once for verdicts and cells; visuals beyond the limits are spread and counted."""
    specs = spark.createDataFrame(
        [(v, f"t{v}", "Table", 0, "dom", False, True, ["k"], ["m"], 0.01, a) for v, a in
         ((1, None), (2, "occurrence"), (3, "positional"))], SPEC + ", align string")
    rows = {v: [{"k": str(i % n), "m": str(i)} for i in range(9)] for v, n in ((1, 99), (2, 3), (3, 99))}
    shown, none = cells(spark, rows), cells(spark, {})

    def found():
        verdicts, made = tables.check_tables(specs, shown, none, shown)
        return verdicts, sorted(tuple(map(str, r)) for r in verdicts.collect()), sorted(tuple(map(str, r)) for r in made.collect())

    verdicts, *usual = found()
    assert [r.verdict for r in verdicts.collect()] == ["ok"] * 3 and len(usual[1]) == 27
    assert "collect_set" not in verdicts._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(tables, "WHOLE_ROWS", 4)
    monkeypatch.setattr(tables, "BLOCK_ROWS", 4)
    monkeypatch.setattr("tallymark.operators.skew.WHOLE_ROWS", 4)
    assert list(found()[1:]) == usual
