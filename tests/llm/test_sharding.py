import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallymark.llm import sharding
from tests.llm.data import documents, near_copies


def greedy(sizes, capacity):
    shards, fill = 1, 0
    for x in sizes:
        shards, fill = (shards, fill + x) if fill + x <= capacity else (shards + 1, x)
    return shards


def test_capacity_is_the_smallest(spark):
    for sizes, shards in (([5, 1, 9, 2, 2, 7], 3), ([4], 2), ([], 3), ([1] * 40, 7), ([100, 1, 1], 2)):
        df = spark.createDataFrame([(sizes,)], "s array<bigint>")
        got = df.select(sharding.minimax_capacity(F.col("s"), shards)).first()[0]
        want = next(c for c in range(max(sizes, default=0), sum(sizes) + 1) if greedy(sizes, c) <= shards)
        assert got == want


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    by_shard, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r["shard"]].append(r)
        of_text[r["text_crc32"], r["size"]].add(r["shard"])
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in of_text.values())
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert sum(r["size"] for r in own) <= own[0]["capacity"]
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want


def test_shards_against_brute_force(spark):
    texts = near_copies() + ["same"] * 300 + ["é" * 50, None]
    docs = documents(spark, texts, ids=[None if i % 50 == 7 else i // 2 for i in range(len(texts))])
    rows = sharding.shard_documents(docs.withColumn("shard", F.lit(99)).withColumn("n", F.lit(1)), 5).collect()
    check(rows, texts, 5)
    assert rows[0]["capacity"] == smallest(texts, 5)


def smallest(texts, shards):
    """Smallest capacity over the groups of equal texts in the order of their digests."""
    groups = defaultdict(int)
    for t in texts:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    sizes = [groups[g] for g in sorted(groups)]
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(sizes, middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("digits, hot, shards", [(1, 0, 24), (1, 400, 7), (1, 0, 3), (2, 30, 24), (1, 5000, 24)])
def test_capacity_over_groups_and_not_pieces(spark, monkeypatch, digits, hot, shards):
    """Few digits at first, so that pieces hold many groups and are split where cuts may fall."""
    monkeypatch.setattr(sharding, "DIGITS", digits)
    rng = random.Random(digits + hot)
    texts = [f"{i} " * rng.choice([1, 3, 40, 200]) for i in range(1500)] + ["hot text " * 9] * hot
    docs = documents(spark, texts, ids=[i if i < 1500 else 1500 + i % 3 for i in range(len(texts))])
    rows = sharding.shard_documents(docs, shards).collect()
    check(rows, texts, shards)
    assert rows[0]["capacity"] == smallest(texts, shards)


def test_equal_rows_beyond_a_run(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 16)
    texts = ["one text"] * 333 + ["another", "third"]
    rows = sharding.shard_documents(documents(spark, texts, ids=[1] * 333 + [2, None]), 3).collect()
    check(rows, texts, 3)


def test_empty_table(spark):
    assert sharding.shard_documents(documents(spark, [])).count() == 0
