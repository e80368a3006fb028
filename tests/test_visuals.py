import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import vocab
from tallymark.functions.classify import CHART_TYPES
from tallymark.operators import captures, visuals
from tallymark.plans import inventory

SHAPE = ("page string, ordinal bigint, type string, full_text string, x double, y double, "
         "width double, height double")


def test_cards_are_taken_apart(spark):
    cases = [("A1x\n5\nB1x\n7", [("A1x", "5"), ("B1x", "7")]), ("A1x\n5\n77%\n7", None),
             ("A1x\n5\nB1x", None), ("", None), ("A1x\n5\nB1x\n7\nC\n9\nD1x\n1", [("A1x", "5"), ("B1x", "7")]),
             ("A1x\n5\nB1x\n7\nC1x", [("A1x", "5"), ("B1x", "7")]), ("A1x\n" + "9" * 51 + "\nB1x\n7", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = df.select(visuals.card_pairs(visuals.lines_of(F.col("t"))).alias("p")).orderBy("i").collect()
    assert [[(p.label, p.value) for p in r.p] if r.p is not None else None for r in got] == [
        want for _, want in cases]


def test_type_index_counts_card_figures(spark):
    rows = [("p", 1, "Card", "Aaa\n1\nBbb\n2", 0.0, 0.0, 1.0, 1.0), ("p", 2, "Card", "Ccc\n3", 0.0, 0.0, 1.0, 1.0),
            ("p", 3, "KPI", "Ddd\n3", 0.0, 0.0, 1.0, 1.0), ("q", 4, "Card", "Eee\n3", 0.0, 0.0, 1.0, 1.0)]
    got = {(r.page, r.title, r.type_index, r.category) for r in inventory.visual_inventory(
        spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == {("p", "Aaa", 0, "kpi"), ("p", "Bbb", 1, "kpi"), ("p", "Ccc", 2, "kpi"),
                   ("p", "Ddd", 0, "kpi"), ("q", "Eee", 0, "kpi")}


@pytest.mark.parametrize("seed", [1, 2])
def test_headings_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        box = rng.random() < 0.4
        rows.append(("hot" if i % 3 == 0 else f"p{rng.randrange(5)}", i, vocab.HEADING_TYPE if box else "Line chart",
                     rng.choice(["", f"Title {i}\nmore"]) if box else "12%", float(rng.randrange(0, 1000)),
                     float(rng.randrange(0, 800)), float(rng.choice([0, 50, 200])), float(rng.choice([0, 30]))))
    want = {}
    for c in rows:
        if c[2] not in CHART_TYPES:
            continue
        best = None
        for b in rows:
            if b[0] != c[0] or b[2] != vocab.HEADING_TYPE or not b[3]:
                continue
            gap = c[5] - (b[5] + b[7])
            if not 0 <= gap <= 80:
                continue
            narrow = min(c[6], b[6])
            shared = max(0.0, min(c[4] + c[6], b[4] + b[6]) - max(c[4], b[4]))
            if narrow > 0 and shared / narrow < 0.30:
                continue
            if best is None or (gap, b[1]) < best[0]:
                best = ((gap, b[1]), b[3].split("\n")[0])
        if best:
            want[c[1]] = best[1]
    got = visuals.headings(visuals.expand_visuals(spark.createDataFrame(rows, SHAPE)))
    assert {r.ordinal: r.heading for r in got.collect()} == want


def test_card_values_prefer_own_title(spark):
    shown = spark.createDataFrame([
        ("p", 1, "Overview\nSales\n9"), ("p", 2, "Sales\nMonday, May 5\nSum of x\n$5M"),
        ("p", 3, "Other\nRate\t\t12%\t "), ("p", 4, "Alone"), ("q", 5, "Sales\nYoY up")],
        "page string, ordinal bigint, full_text string")
    specs = spark.createDataFrame([("p", t) for t in ("Sales", "Rate", "Alone", "Gone")] + [("q", "Sales")],
                                  "page string, visual_title string")
    got = {(r.page, r.visual_title): r.raw for r in visuals.card_values(specs, shown).collect()}
    assert got == {("p", "Sales"): "$5M", ("p", "Rate"): "12%", ("p", "Alone"): "Alone", ("p", "Gone"): None,
                   ("q", "Sales"): "YoY up"}


def test_locating(spark):
    shown = spark.createDataFrame([("p", 1, "Table", 0, "A"), ("p", 2, "Table", 1, "A"), ("p", 3, "Map", 0, "")],
                                  "page string, ordinal bigint, type string, type_index bigint, title string")
    specs = spark.createDataFrame([(1, "p", "A", "", None), (2, "p", "", "Table", 1), (3, "p", " ", "Table", 2),
                                   (4, "p", "", "Map", None), (5, "p", "Z", "Map", 0), (6, "p", "", "", None)],
                                  "spec_id int, page string, visual_title string, visual_type string, visual_index int")
    got = {r.spec_id: (r.ordinal, r.available_of_type) for r in visuals.locate(specs, shown).collect()}
    assert got[1] == (1, 0) and got[2] == (2, 2) and got[3] == (None, 2) and got[4] == (3, 1)
    assert got[5][0] is None and got[6][0] == 3


def test_chart_points_take_the_first_way(spark):
    labels = spark.createDataFrame([(1, 1, "A. 5."), (1, 2, "A. 5."), (2, 1, "Axis")], "visual_id int, seq int, label string")
    bars = spark.createDataFrame([(1, 0, "9"), (2, 0, "5"), (2, 1, "6"), (2, 2, "5")], "visual_id int, seq int, value string")
    ticks = spark.createDataFrame([(1, 0, "Z"), (2, 0, "XX"), (2, 1, "1,5"), (2, 2, "YbYb")], "visual_id int, seq int, text string")
    texts = spark.createDataFrame([(3, 0, "Name"), (3, 1, "$5bn"), (4, 0, "N1"), (4, 1, "N2"), (4, 2, "77")],
                                  "visual_id int, seq int, text string")
    got = sorted((r.visual_id, r.method, r.category, r.value) for r in
                 captures.chart_points(labels, bars, ticks, texts).collect())
    assert got == [(1, 1, "A", "5"), (2, 2, "X", "5"), (2, 2, "Yb", "6"), (3, 3, "Name", "$5bn")]


def test_grids(spark):
    cells = spark.createDataFrame([(1, 1, 0, "A", "x"), (1, 1, 1, "B", ""), (1, 2, 0, "A", ""), (1, 2, 1, "B", "")],
                                  "visual_id int, row_no int, col_no int, col_name string, raw string")
    assert [tuple(r) for r in captures.grid(cells, ["visual_id", "row_no"], ["A", "B"]).collect()] == [(1, 1, "x", "")]
    assert captures.drop_empty_rows(cells, ["visual_id", "row_no"]).count() == 2
    assert captures.header_lists(cells).first().headers == ["A", "B"]
    shown = captures.preview(cells).first()
    assert (shown.rows, shown.columns, shown.first_row) == (2, "A, B", "x | ")
    reported = spark.createDataFrame([(1, 5), (2, 0)], "visual_id int, reported_total int")
    assert {(r.visual_id, r.captured_rows, r.partial) for r in captures.capture_completeness(
        cells, reported).collect()} == {(1, 2, True), (2, 0, False)}


def test_bars_are_numbered_before_they_take_labels(spark):
    bars = spark.createDataFrame([(1, 10, "7"), (1, 20, " "), (1, 30, "8"), (1, 1_000_000, "9")],
                                 "visual_id int, seq bigint, value string")
    ticks = spark.createDataFrame([(1, 5, "A"), (1, 6, "B")], "visual_id int, seq bigint, text string")
    got = {(r.category, r.value) for r in captures.bars_on_axis(bars, ticks).collect()}
    assert got == {("A", "7"), ("A", "8"), ("B", "9")}


def test_a_full_strip(spark):
    """100 000 boxes and 20 000 charts within 80 px of height: pairs of them would be 2 * 10^9."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, m = 100_000, 20_000
    bx, bw, bottom = rng.uniform(0, 9000, n), rng.uniform(5, 300, n), rng.uniform(800, 840, n)
    bottom[:n // 2] = 801.0  # a row of headings far above, and others that are too far to the side
    x, w, y = rng.uniform(0, 9000, m), rng.uniform(5, 300, m), rng.uniform(841, 879, m)
    x[:200] = 20_000
    rows = [("p", i, vocab.HEADING_TYPE, f"b{i}", float(a), float(c) - 10, float(b), 10.0, f"b{i}", False)
            for i, (a, b, c) in enumerate(zip(bx, bw, bottom))]
    rows += [("p", n + i, "Line chart", "12%", float(a), float(c), float(b), 30.0, "12%", True) for i, (a, b, c) in enumerate(zip(x, w, y))]
    df = spark.createDataFrame(rows, "page string, ordinal bigint, type string, full_text string, x double, y double, "
                                     "width double, height double, title string, noisy boolean").repartition(8)
    got = {r.ordinal - n: r.heading for r in visuals.headings(df).collect()}
    bottom = (bottom - 10) + 10
    for i in [*range(0, 400, 40), *range(200, m, 300)]:
        shared = np.minimum(bx + bw, x[i] + w[i]) - np.maximum(bx, x[i])
        fits = (y[i] - bottom >= 0) & (y[i] - bottom <= 80) & (np.maximum(shared, 0) / np.minimum(bw, w[i]) >= 0.3)
        want = f"b{np.flatnonzero(fits)[np.argmin((y[i] - bottom)[fits])]}" if fits.any() else None
        assert got.get(i) == want
