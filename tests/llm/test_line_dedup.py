import hashlib
import random
import re

import pytest

from tallymark.llm import line_dedup
from tests.llm.data import documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)


def brute(rows):
    """(n_lines, n_dropped, kept text) per (doc_id, text); a missing id comes last."""
    order = [(i is None, i or 0) for i, _ in rows]
    first = {}
    for o, (_, text) in zip(order, rows):
        for line in (text or "").split("\n"):
            first[key_of(line)] = min(first.get(key_of(line), o), o)
    out = []
    for o, (i, text) in zip(order, rows):
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 10 or first[key_of(x)] == o]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lines(seed, n):
    rng = random.Random(seed)
    pool = [f"A shared line number {i}" for i in range(30)] + ["short", "", "  ", "Über straße 9", "exactly 10", "éééééééééé"]
    made = []
    for _ in range(n):
        some = [rng.choice(pool) for _ in range(rng.randrange(0, 12))]
        some = [rng.choice((x, f" {x}\t", x.upper(), f"{x}\r", f"\xa0{x}")) for x in some]
        some += ["the line that all hold"] * rng.randrange(0, 3)
        made.append("\n".join(some))
    return made


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("parts", ["1", "8", "40"])
def test_against_brute_force(spark, parts):
    """Runs of one hash that cross ranges, whatever their number; clashing names of extra columns."""
    texts = lines(3, 300) + ["", None, "\n\n", "one line alone in its document\n" * 3, "x" * 200_000]
    ids = [*range(500, 500 + len(texts) - 6), None, None, 3, 3, 7, 7]
    rows = list(zip(ids, texts))
    docs = documents(spark, texts, ids=ids).withColumnRenamed("lang", "keep").withColumnRenamed("source", "position")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup.dedup_lines(docs, ["doc_id", "text"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(str(i), n, d, digest(t)) for i, n, d, t in brute(rows)]
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == sorted(want)
    assert all(digest(line_dedup.kept_lines(r["text"], r["keep"])) == r["kept_sha256"] for r in got)
    assert max(len(r["keep"]) for r in got) < 64


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["the same old line\nshort"] * 50 + ["the same old line"], ids=[4] * 50 + [9])
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs, ["doc_id"]).collect()}
    assert got == {(4, 2, 0), (9, 1, 1)}
    assert line_dedup.dedup_lines(documents(spark, []), ["doc_id"]).count() == 0
