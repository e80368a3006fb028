import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.operators import catalog, foreign_keys
from tallymark.plans import suggest


def form(s):
    return re.sub("[^a-z0-9]", "", s.lower())


def brute(header, columns):
    h, best, level = form(header), ("", ""), 0
    for table, column in columns:
        c = form(column)
        if not h or not c:
            continue
        w = 3 if h == c else 2 if h in c or c in h else int(
            len(h) >= 4 and any(h[i:i + 4] in c for i in range(len(h) - 3)))
        if w > level:
            best, level = (table, column), w
    return (*best, ["NONE", "LOW", "MEDIUM", "HIGH"][level])


def frame(spark, columns):
    tables = list(dict.fromkeys(t for t, _ in columns))
    rows = [(t, tables.index(t), c, i, "INTEGER", True) for i, (t, c) in enumerate(columns)]
    return spark.createDataFrame(rows, "table string, table_no int, column string, column_no int, "
                                       "type string, nullable boolean")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_lookup_equals_pairwise_matching(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd_ ") for _ in range(rng.randrange(1, 9)))
    columns = sorted({(f"t{rng.randrange(3)}", word()) for _ in range(25)})
    headers = list({word() for _ in range(60)} | {"", "%", "Total " + columns[0][1]})
    df = spark.createDataFrame([(h,) for h in headers], "header string")
    got = {r.header: (r.db_table, r.db_col, r.confidence) for r in
           catalog.match_columns(df, frame(spark, columns)).collect()}
    assert got == {h: brute(h, columns) for h in headers}


def test_blank_headers_can_match_the_first_column(spark):
    df = spark.createDataFrame([("%",), ("sales",)], "header string")
    got = {r.header: (r.db_col, r.confidence) for r in catalog.match_columns(
        df, frame(spark, [("t", "market"), ("t", "sales")]), empty_header_matches=True).collect()}
    assert got == {"%": ("market", "MEDIUM"), "sales": ("sales", "HIGH")}


def test_matching_has_no_cross_join(spark):
    df = spark.createDataFrame([("x",)], "header string")
    plan = catalog.match_columns(df, frame(spark, [("t", "sales")]))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_suggestions(spark):
    columns = spark.createDataFrame([
        ("dim_a", 0, "region", 0, "VARCHAR"), ("fact_sales", 1, "market", 0, "VARCHAR"),
        ("fact_sales", 1, "sales", 1, "DECIMAL(10,2)"), ("fact_sales", 1, "margin_rate", 2, "DOUBLE")],
        "table string, table_no int, column string, column_no int, type string")
    cards = spark.createDataFrame([("Sales",), ("Sales YoY",), ("Margin Rate",), ("zzz",), ("Number of Sales",)],
                                  "header string")
    got = {r.header: (r.db_col, r.agg, r.confidence) for r in suggest.suggest_kpis(cards, columns).collect()}
    assert got == {"Sales": ("sales", "SUM", "HIGH"), "Sales YoY": ("", "", "NONE"),
                   "Margin Rate": ("margin_rate", "AVG", "MEDIUM"), "zzz": ("", "", "NONE"),
                   "Number of Sales": ("sales", "SUM", "MEDIUM")}
    headers = spark.createDataFrame([(1, 0, "Market"), (1, 1, "Sales"), (1, 2, "Region"), (2, 0, "zzz"),
                                     (3, 0, "Market")], "visual_id int, col_no int, header string")
    roles = {(r.visual_id, r.header): (r.source_table, r.role, r.agg, r.confidence) for r in
             suggest.suggest_tables(headers, columns).collect()}
    assert roles == {(1, "Market"): ("fact_sales", "key", "", "HIGH"), (1, "Sales"): ("fact_sales", "measure", "SUM", "HIGH"),
                     (3, "Market"): ("fact_sales", "key", "", "HIGH")}
    fact = spark.createDataFrame([("n", 1.0), ("n", 2.0), ("s", 5.0)], "market string, sales double")
    query = suggest.grouped_query(fact, [("Market", "market", "key", ""), ("Sales", "sales", "measure", "SUM")])
    assert {tuple(r) for r in query.collect()} == {("n", 3.0), ("s", 5.0)}


def test_ties_prefer_fact_tables_then_first(spark):
    rows = [(1, "a", "HIGH", 0), (1, "fact_b", "HIGH", 1), (2, "x", "LOW", 0), (2, "y", "LOW", 1), (2, "", "NONE", 2)]
    df = spark.createDataFrame(rows, "v int, db_table string, confidence string, o int").withColumn(
        "is_numeric", F.lit(False))
    got = {r.v: (r.db_table, r.score, r.confidence) for r in catalog.header_sets(df, ["v"], "o").collect()}
    assert got == {1: ("fact_b", 3, "HIGH"), 2: ("x", 1, "LOW")}


def test_foreign_keys(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    r = catalog.check_foreign_key(child, "k", parent, "id").first()
    assert (r.child_rows, r.orphan_rows, r.repeated_parent_keys, r.holds) == (5, 1, 1, False)
    assert catalog.check_foreign_key(child.where("k < 3"), "k", parent.distinct(), "id").first().holds


def test_catalog_of_schemas(spark):
    got = catalog.catalog_of({"a": spark.range(1), "b": spark.createDataFrame([("x",)], "s string")})
    assert {(r.table, r.column, r.type) for r in got.collect()} == {("a", "id", "BIGINT"), ("b", "s", "STRING")}


def test_keys_of_several_columns(spark, tmp_path):
    child = spark.createDataFrame(
        [(1, "x", 1.0), (1, "x", 2.0), (2, "y", 3.0), (1, "y", 4.0), (None, "x", 5.0), (3, None, None)], "a int, b string, f double")
    parent = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (2, "y", 3), (None, "x", 4), (None, "x", 5)], "id bigint, name string, n int")
    declared = spark.createDataFrame([
        ("child", ["a", "b"], "parent", ["id", "name"]), ("child", ["a"], "parent", ["id"]), ("child", ["b"], "parent", ["name"]),
        ("child", ["f"], "parent", ["n"]), ("child", ["b", "a"], "parent", ["name", "id"]), ("child", ["a", "b"], "parent", ["id", "name"]),
        ("child", ["a"], "parent", ["id", "name"]), ("child", ["zz"], "parent", ["id"]), ("other", ["a"], "parent", ["id"])],
        "from_table string, from_cols array<string>, to_table string, to_cols array<string>")
    got = {",".join(r.from_cols): tuple(r)[4:] for r in foreign_keys.check_keys({"child": child, "parent": parent}, declared).collect()}
    assert got == {"a,b": (6, 2, 1, 1, False), "b,a": (6, 2, 1, 1, False), "a": (6, 1, 1, 1, False), "b": (6, 1, 0, 2, False),
                   "f": (6, 1, 0, 0, True)}


def test_a_table_is_read_once_for_all_its_keys(spark, tmp_path, monkeypatch):
    spark.range(50).selectExpr("id AS a", "id % 7 AS b", "id % 5 AS c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    declared = spark.createDataFrame([("t", [c], "t", [d]) for c in "abc" for d in "abc"],
                                     "from_table string, from_cols array<string>, to_table string, to_cols array<string>")
    plans = []
    monkeypatch.setattr(foreign_keys, "cut", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or d)
    checked = foreign_keys.check_keys({"t": df}, declared)
    assert [p.count("Relation [") for p in plans] == [1]
    assert {(r.from_cols[0], r.to_cols[0]): r.orphan_rows for r in checked.collect()}["a", "b"] == 43


@pytest.mark.parametrize("seed", [4, 5])
def test_long_names_and_headers(spark, seed):
    """Names and headers beyond the texts that are looked up whole, few letters so that runs are shared."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    columns = [(f"t{i % 3}", word(rng.randrange(5, 26))) for i in range(120)]
    columns = sorted(set(columns) | {("t9", "x" + word(40)), ("t9", "same_name_of_a_column"), ("t8", "Same Name of a Column")})
    parts = [c for _, c in columns]
    headers = {rng.choice(parts)[rng.randrange(3):][:rng.randrange(4, 24)] for _ in range(80)}
    headers |= {word(3) + rng.choice(parts) + word(4) for _ in range(40)} | {word(30) for _ in range(20)} | {"Same-name of a column", "aaaaaaaaab", "b" * 9}
    df = spark.createDataFrame([(h,) for h in sorted(headers)], "header string")
    got = {r.header: (r.db_table, r.db_col, r.confidence) for r in catalog.match_columns(df, frame(spark, columns)).collect()}
    assert got == {h: brute(h, columns) for h in headers}


def test_a_header_of_ten_thousand_characters(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghij0123456789") for _ in range(10_000))
    columns = [("t", f"nothing {i}") for i in range(50)] + [("t", text[7_000:7_030]), ("t", text[100:104])]
    df = spark.createDataFrame([(text,), (text[:5_000] + "!" + text[5_000:],), (text[2_000:],)], "header string")
    got = {r.header: (r.db_col, r.confidence) for r in catalog.match_columns(df, frame(spark, columns)).collect()}
    assert got == {h: (text[7_000:7_030], "MEDIUM") for h, in df.collect()}
    long_name = [("t", text), ("t", "other")]
    inside = spark.createDataFrame([(text[50:9_000],), (text,)], "header string")
    got = {len(r.header): (r.db_col == text, r.confidence) for r in catalog.match_columns(inside, frame(spark, long_name)).collect()}
    assert got == {8_950: (True, "MEDIUM"), 10_000: (True, "HIGH")}


def test_keys_of_several_types_meet_without_sorting(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(foreign_keys, "cut", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or d)
    child = spark.createDataFrame([(1, "a", 7), (1, "b", 8), (None, "a", 9), (2, None, 7), (3, "a", 7)], "k int, s string, m int")
    parent = spark.createDataFrame([(1, "a", 7), (2, "c", 7), (3, "a", 5), (3, "a", 6)], "k bigint, s string, m bigint")
    declared = spark.createDataFrame([
        ("child", ["k", "s"], "parent", ["k", "s"]), ("child", ["m", "s"], "parent", ["k", "s"]),
        ("child", ["s", "k"], "parent", ["s", "k"]), ("child", ["m"], "parent", ["m"]), ("parent", ["k"], "child", ["k"])],
        "from_table string, from_cols array<string>, to_table string, to_cols array<string>")
    got = {(r[0], ",".join(r.from_cols)): tuple(r)[4:] for r in foreign_keys.check_keys(
        {"child": child, "parent": parent}, declared).collect()}
    assert got == {
        ("child", "k,s"): (5, 2, 1, 1, False), ("child", "m,s"): (5, 1, 4, 1, False), ("child", "s,k"): (5, 2, 1, 1, False),
        ("child", "m"): (5, 0, 2, 1, False), ("parent", "k"): (4, 0, 0, 1, False)}
    assert plans and not any(x in p for p in plans for x in ("ObjectHashAggregate", "SortAggregate"))
