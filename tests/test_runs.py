import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.plans import inventory, runs


def segment(log):
    """Steps of one log, line by line."""
    steps, current = [], None
    for _, level, msg in log:
        start = re.match(r"STEP(\d)_START\|(.+)", msg)
        if start:
            current = [int(start[1]), start[2], 0, False]
            steps.append(current)
        elif re.match(r"STEP(\d)_END", msg):
            current = None
        elif current is not None:
            current[2] += 1
            current[3] |= level == "ERROR" or msg.startswith("FAIL") or "AssertionError" in msg
    return [tuple(s) for s in steps]


@pytest.mark.parametrize("block", [1, 5, 10**6])
def test_steps_match_a_line_by_line_scan(spark, block):
    rng = random.Random(2)
    logs = {}
    for i in range(600):
        test = "hot" if i % 3 else rng.choice(["a", "b"])
        msg = rng.choice(["STEP1_START|One", "STEP2_START|Two words", "STEP1_END", "line", "line", "line", "FAIL x",
                          "saw AssertionError", "STEP_START|no", "STEP3_START|"])
        logs.setdefault(test, []).append((i, rng.choice(["INFO", "INFO", "ERROR"]), msg))
    df = spark.createDataFrame([(t, *row) for t, rows in logs.items() for row in rows],
                               "test_id string, seq bigint, level string, msg string").repartition(6)
    found = runs.steps(runs.step_lines(df, block_rows=block)).collect()
    for test, rows in logs.items():
        got = [(r.step_no, r.title, r.lines, r.failed) for r in
               sorted((r for r in found if r.test_id == test), key=lambda r: r.step)]
        assert got == segment(rows)


def test_last_step_of_a_failed_test(spark):
    steps = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 1, True), ("c", 1, False), ("d", 1, False)],
                                  "test_id string, step int, failed boolean")
    results = spark.createDataFrame([("a", "failed", "x\nE   AssertionError: 3 differ \nE   assert y"), ("b", "failed", ""),
                                     ("c", "passed", ""), ("d", "failed", "E   assert 1 == 2")],
                                    "test_id string, outcome string, error_text string")
    got = {(r.test_id, r.step): (r.failed, r.summary) for r in runs.mark_last_steps(steps, results).collect()}
    assert got == {("a", 1): (False, None), ("a", 2): (True, "3 differ"), ("b", 1): (True, None),
                   ("c", 1): (False, None), ("d", 1): (True, "assert 1 == 2")}


def test_summaries(spark):
    df = spark.createDataFrame([("test_kpi", "passed", 10), ("test_kpi", "failed", 5), ("test_table", "skipped", 1)],
                               "name string, outcome string, duration int")
    r = runs.run_summary(df).first()
    assert (r.total, r.passed, r.failed, r.skipped, r.pass_rate, r.fail_rate, r.duration) == (3, 1, 1, 1, 33.3, 33.3, 16)
    empty = runs.run_summary(df.where(F.lit(False))).first()
    assert (empty.total, empty.pass_rate) == (0, 0.0)
    assert {r.test_group[:7]: r.total for r in runs.grouped_summary(df).collect()} == {"GROUP 2": 2, "GROUP 3": 1}


def test_latest_runs(spark):
    df = spark.createDataFrame([("s", 1, "old"), ("s", 3, "new"), ("t", 2, "only")], "suite string, ts int, v string")
    assert {(r.suite, r.v) for r in runs.latest_runs(df, ["suite"], "ts").collect()} == {("s", "new"), ("t", "only")}


def test_zero_filled_counts(spark):
    visuals = spark.createDataFrame([("p", 1, "Pie chart", "chart", "x"), ("p", 2, "Card", "kpi", "y")],
                                    "page string, ordinal int, type string, category string, title string")
    assert {(r.method, r.charts) for r in inventory.extraction_coverage(visuals).collect()} == {
        ("aria", 1), ("show_as_table", 0), ("unknown", 0)}
    counts = {r.page: (r.kpis, r.charts, r.visuals) for r in inventory.page_counts(visuals).collect()}
    assert counts == {"p": (1, 1, 2), None: (1, 1, 2)}
    levels = spark.createDataFrame([("HIGH",), ("HIGH",), ("NONE",)], "confidence string")
    assert {(r.confidence, r.suggestions) for r in inventory.confidence_histogram(levels).collect()} == {
        ("HIGH", 2), ("MEDIUM", 0), ("LOW", 0), ("NONE", 1)}
