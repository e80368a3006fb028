import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators.captures import MODULUS, _power, drop_repeats, stitch_pages
from tallymark.operators.ranking import running_sums

SCHEMA = "visual_id int, page int, row_no int, a string, b int"


def brute(rows):
    """Pages of a visual in order; the longest end of one that begins the next is left out there."""
    kept, pages = [], {}
    for r in rows:
        pages.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    for own in pages.values():
        before = []
        for page in sorted(own):
            now = sorted(own[page], key=lambda r: r[2])
            cells = [r[3:] for r in now]
            k = max((k for k in range(1, min(len(before), len(cells)) + 1) if before[-k:] == cells[:k]), default=0)
            kept += now[k:]
            before = cells
    return sorted(kept, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for visual in range(60):
        letters = rng.choice(["x", "xy", "pqrstuvw"])
        whole = [(rng.choice([*letters, None, ""]), rng.choice([None, 1])) for _ in range(rng.randrange(1, 60))]
        at, page = 0, -3
        while at < len(whole):
            size, page = rng.randrange(1, 20), page + rng.randrange(1, 4)
            rows += [(visual, page, 5 + 2 * i, *c) for i, c in enumerate(whole[at:at + size])]
            at += rng.randrange(1, size + 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = stitch_pages(df, ["visual_id"], "page", "row_no", ["a", "b"])
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert got.columns == df.columns


def test_true_repeats_stay(spark):
    cells = ["h", "a", "a", "b", "a", "a", "c", "a"]
    pages = [cells[:5], cells[3:7], cells[6:]]
    rows = [(1, p, i, c, 0) for p, own in enumerate(pages) for i, c in enumerate(own)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = stitch_pages(df, ["visual_id"], "page", "row_no", ["a", "b"]).orderBy("page", "row_no").collect()
    assert [r.a for r in kept] == cells
    assert drop_repeats(df, ["visual_id"], ["a", "b"], "row_no").count() == 4
    assert stitch_pages(df.limit(0), ["visual_id"], "page", "row_no", ["a", "b"]).count() == 0


def test_running_sums_in_blocks(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id DIV 3 * 2 AS n", "id AS v", "id * id AS w")
    got = running_sums(df, ["g"], "n", {"v": "sv", "w": "sw"}, {"w": "tw"}, block_rows=5).collect()
    rows = [tuple(r) for r in df.collect()]
    for r in got:
        upto = [x for x in rows if x[0] == r.g and x[1] <= r.n]
        assert (r.sv, r.sw, r.tw) == (sum(x[2] for x in upto), sum(x[3] for x in upto), sum(x[3] for x in rows if x[0] == r.g))


def test_powers(spark):
    exponents = [0, 1, 2, 63, 1000, 2 ** 31, 2 ** 39 + 7]
    df = spark.createDataFrame([(e,) for e in exponents], "e bigint")
    assert [r[0] for r in df.select(_power(16807, F.col("e"))).collect()] == [pow(16807, e, MODULUS) for e in exponents]


def test_large_pages_and_small_ones_agree(spark, monkeypatch):
    """Pages beyond the limits go in blocks and are spread, the others are windows and stay whole."""
    from tallymark.operators import captures, skew

    rng = random.Random(5)
    rows = [(v, p, 3 * i, rng.choice("ab"), rng.choice([None, 1])) for v in range(12) for p in range(3) for i in range(rng.randrange(1, 14))]
    monkeypatch.setattr(captures, "BLOCK_ROWS", 6)
    monkeypatch.setattr(skew, "WHOLE_ROWS", 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = stitch_pages(df, ["visual_id"], "page", "row_no", ["a", "b"]).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_rows_are_derived_once(spark):
    """The pages are read by one pass, however often their places and sums are needed."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(1, p, i, "x", 10 * p + i) for p in range(3) for i in range(5)], SCHEMA).mapInArrow(count, SCHEMA)
    assert stitch_pages(df, ["visual_id"], "page", "row_no", ["a", "b"]).count() == 15
    assert read.value == 15
