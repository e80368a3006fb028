import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.functions import numbers

DISPLAY = [
    ("$4.2M", 4200000.0), ("1.5K", 1500.0), ("3.2M", 3200000.0), ("2.1B", 2100000000.0),
    ("87.5%", 87.5), ("1,234,567", 1234567.0), ("(1,234)", -1234.0), ("-1,234", -1234.0),
    ("12345", 12345.0), ("", None), ("–", None), ("-", None), ("N/A", None), ("n/a", None),
    ("null", None), ("Null", None), (None, None), ("620.4% ▲", 620.4), ("45% ▼", 45.0),
    ("(-5)", 5.0), ("$(5)", None), ("(5%)", -5.0), ("50K%", 50000.0), ("1.2bn", None),
    ("1.5T", None), ("12 , 3", 123.0), ("NULL", None), ("(Blank)", None), ("1 234", 1234.0),
    ("1d", None), ("1f", None), ("nan", None), ("inf", None), ("  7  ", 7.0), ("5k", 5000.0),
    (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("+3", 3.0), ("%", None), ("()", None),
    ("₹1,00,000", 100000.0), ("5 ↑↑", 5.0), ("Sum of Attrition Count 133 (56.12%)", None),
]


def evaluate(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_display_numbers(spark):
    got = evaluate(spark, [t for t, _ in DISPLAY], numbers.display_number)
    wrong = [(t, want, g) for (t, want), g in zip(DISPLAY, got) if want != g and not (
        want is not None and g is not None and abs(want - g) <= abs(want) * 1e-12)]
    assert not wrong


def test_plain_numbers_take_no_display_forms(spark):
    assert evaluate(spark, ["1234", "1,234", "12%", " 5 ", "1e2", "x", None],
                    numbers.plain_number) == [1234.0, None, None, 5.0, 100.0, None, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-10**12, 10**12), min_size=1, max_size=60))
def test_formatted_integers_come_back(spark, values):
    forms = []
    for v in values:
        forms += [(f"{v:,}", v), (f"${abs(v):,}", abs(v)), (f"({abs(v):,})", -abs(v)),
                  (f"{v}%", v), (f"{v}K", v * 1000)]
    got = evaluate(spark, [t for t, _ in forms], numbers.display_number)
    assert got == [float(v) for _, v in forms]


def test_page_count(spark):
    texts = ["1of19", "1 of 3", "1of31- Ticket Volume2- Other", "nothing", "0 of 0", "1of11"]
    assert evaluate(spark, texts, numbers.page_count) == [19, 3, 3, 1, 1, 11]
    hidden = lambda c: numbers.page_count(c, F.lit(True))
    assert evaluate(spark, ["1of11"], hidden) == [1]


def test_detail_lines(spark):
    df = spark.createDataFrame(
        [("k", "$10", 10.0, 20.0), ("", "5", 5.0, None), (None, None, None, None),
         ("z", None, None, 7.0)], "label string, raw string, p double, s double")
    got = [r.d for r in df.select(numbers.comparison_detail(
        F.col("label"), F.col("raw"), F.col("p"), F.col("s"),
        F.abs(F.col("p") - F.col("s")) / F.col("s"), F.lit(0.01), F.lit(False)).alias("d")).collect()]
    assert got[0] == ("[k] failed: shown $10, read as 10.0000, expected 20.0000, "
                      "off by 50.0000% of at most 1.00%")
    assert got[1] == "failed: shown 5, read as 5.0000, nothing to expect"
    assert got[2] is None or got[2].endswith("ok: no value on either side")
    assert got[3] == "[z] failed: nothing shown, expected 7.0000"


@pytest.mark.parametrize("text", ["a ", "\t5 "])
def test_strip_takes_unicode_blanks(spark, text):
    assert not re.search(r"\s", evaluate(spark, [text], numbers.strip)[0])
