from pyspark.sql import functions as F

from tallymark.functions import classify, compare, text
from tests.test_numbers import evaluate


def test_noisy_titles(spark):
    noisy = ["", "▲", "$4.2M", "(5)", "1,234", "87.5%", "12 %", "Scroll up", "scroll LEFT", "5K", None]
    named = ["Sales", "Scroll upward", "K5", "▲▲▲", "Total (net)"]
    assert evaluate(spark, noisy + named, text.is_noisy) == [True] * 11 + [False] * 5


def test_titles(spark):
    long = "x" * 100
    assert evaluate(spark, ["\n \n a \nb", "", None, 'say "hi"\n'], text.safe_title) == [
        "a", "", "", "say 'hi'"]
    assert evaluate(spark, [long], text.safe_title) == ["x" * 80 + "…"]
    assert evaluate(spark, ["a\nb"], text.snippet) == ["a | b"]


def test_undouble(spark):
    assert evaluate(spark, ["abab", "aba", "aa", "", "abcabd"], text.undouble) == [
        "ab", "aba", "a", "", "abcabd"]


def test_point_labels(spark):
    labels = ["The Weeknd. Sum of streams. 4,655,506,388.", "2023. $1.2M.", "Axis", "a", "A. b. c. 5",
              "ab."]
    got = evaluate(spark, labels, text.point_label)
    assert [tuple(p) if p else None for p in got] == [
        ("The Weeknd", "Sum of streams", "4,655,506,388"), ("2023", None, "$1.2M"), None, None,
        ("A", "b, c", "5"), None]


def test_api_columns(spark):
    assert evaluate(spark, ["[Region]", "Region[Name]", "Sales[Total Revenue]", " Sum of Revenue"],
                    text.api_column) == ["region", "name", "total revenue", "sum of revenue"]


def test_labels_and_groups(spark):
    df = spark.createDataFrame([("t", "x", 1), ("", "Table", 0), ("", "", 0), (None, "Map", None)],
                               "title string, type string, i int")
    assert [r.l for r in df.select(text.human_label(
        F.col("title"), F.col("type"), F.col("i")).alias("l")).collect()] == [
        "t", "Table[0]", "Unknown", "Map[None]"]
    groups = evaluate(spark, ["test_kpi_discover", "all_kpis", "table", "x"], classify.test_group)
    assert [g[6] for g in groups] == ["1", "2", "3", "4"]


def test_aggregate_inference(spark):
    cases = [("order_count", "INTEGER", "COUNT"), ("qty", "INTEGER", "SUM"), ("avg_x", "INT", "AVG"),
             ("margin", "DECIMAL", "AVG"), ("sales", "DECIMAL(10,2)", "SUM"), ("region", "VARCHAR", ""),
             ("account", "VARCHAR", "COUNT"), ("sale_date", "DATE", "SUM")]
    df = spark.createDataFrame(cases, "c string, t string, want string")
    for r in df.select("c", "want", text.inferred_aggregate(F.col("c"), F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.c


def test_categories(spark):
    cases = [("Card", "Sales", "Sales\n5", "kpi"), ("Card", "TopN", "5%", "slicer"),
             ("KPI", "x", "pick a Field", "slicer"), ("KPI", "x", "Field 5%", "kpi"),
             ("Table", "t", "", "chart"), ("Date Slicer", "d", "", "slicer"), ("img", "", "", "other")]
    df = spark.createDataFrame(cases, "t string, title string, body string, want string")
    for r in df.select("*", classify.category(F.col("t"), F.col("title"), F.col("body")).alias("got")).collect():
        assert r.got == r.want, r
    assert evaluate(spark, ["Pie chart", "Matrix", "Stacked area chart"], classify.extraction_method) == [
        "aria", "show_as_table", "unknown"]


def test_untyped_tables(spark):
    df = spark.createDataFrame(
        [("", "Scroll up\n1", "Table"), ("", "x\n rank ", "Table"), ("", "x", ""), ("Map", "Rank", "Map"),
         (None, "Agent ID", "Table")], "t string, body string, want string")
    for r in df.select("*", classify.effective_type(F.col("t"), F.col("body")).alias("got")).collect():
        assert r.got == r.want, r


def test_value_status(spark):
    nan = float("nan")
    cases = [(100.0, 101.0, "match"), (100.0, 102.0, "mismatch"), (None, None, "both_null"),
             (None, 1.0, "published_null"), (1.0, None, "source_null"), (nan, 1.0, "not_a_number"),
             (0.0, 0.005, "match"), (0.0, 0.5, "mismatch"), (nan, nan, "not_a_number")]
    df = spark.createDataFrame(cases, "p double, s double, want string")
    status = compare.value_status(F.col("p"), F.col("s"), F.lit(0.01))
    for r in df.select("*", status.alias("got"), compare.passes(status, "strict").alias("strict")).collect():
        assert r.got == r.want
        assert r.strict == (r.want == "match")


def test_selection(spark):
    cases = [(["2024"], "2024", True), (["All"], "ALL", True), (["a", "b"], "a, b", True),
             (["a", "b"], "all", False), (["a"], " a ", True), (["a"], None, False)]
    df = spark.createDataFrame(cases, "v array<string>, e string, want boolean")
    for r in df.select("*", compare.selection_matches(F.col("v"), F.col("e")).alias("got")).collect():
        assert r.got == r.want


def test_one_trimming_rule(spark):
    blanks = "\u00a0 \t"
    assert evaluate(spark, [f"{blanks}\n{blanks}Sales{blanks}\nx"], text.first_line) == ["Sales"]
    assert evaluate(spark, [f"a{blanks}\n{blanks}\n b"], text.lines_of) == [["a", "b"]]
    point = evaluate(spark, [f"{blanks}A{blanks}. {blanks}5{blanks}."], text.point_label)[0]
    assert (point.category, point.value) == ("A", "5")
    df = spark.createDataFrame([("the house", f"HOUSE{blanks}\n")], "raw string, want string")
    assert df.select(compare.text_matches(df.raw, df.want)).first()[0]
    assert evaluate(spark, [f"{blanks}Net Sales{blanks}"], text.normalise_header) == ["net sales"]
