"""The stages against brute force on one small folder."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import decontamination, jaccard, mixing
from tests.llm.data import documents
from tests.llm.test_jaccard import brute as components
from tests.llm.test_jaccard import near_group
from tests.llm.test_quality import brute as counts
from tests.llm.test_sharding import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), {"documents": None}
    stages["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        stages[name] = made.collect()
        docs = spark.createDataFrame(stages[name], made.schema)
    return stages


def test_stages_keep_the_columns(kept):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name] and kept[name][0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_quality_drops_what_fails(spark, kept):
    left = {r["doc_id"] for r in kept["quality"]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in kept["documents"]:
        n, _, _, _, repeated = counts(r["text"])
        if n < 50 or 100 * repeated > 50 * n:
            assert r["doc_id"] not in left
        elif labels.get(r["doc_id"]) == 1:
            assert r["doc_id"] in left


def test_one_document_of_each_group(kept):
    rows = sorted(kept["quality"], key=lambda r: r["doc_id"])
    want = {rows[top]["doc_id"] for _, top in components([r["text"] for r in rows]).values()}
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == sorted(want)


def test_benchmark_passages_go(spark, kept):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9)) if w}

    def hit(text):
        w = words(text)
        return any(tuple(w[i:i + k]) in windows for k in {len(x) for x in windows} for i in range(len(w) - k + 1))

    want = {r["doc_id"] for r in kept["near_duplicates"] if not hit(r["text"])}
    assert {r["doc_id"] for r in kept["decontamination"]} == want


def test_mix_repeats_documents_as_taken(spark, kept):
    rows = kept["decontamination"]
    docs = documents(spark, [r["text"] for r in rows], [r["doc_id"] for r in rows], [r["source"] for r in rows])
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect() if r["copies"]}
    got: dict = {}
    for r in kept["mixing"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want
    words = sum(len((r["text"] or "").split()) for r in kept["mixing"])
    assert math.isclose(words, 1.5 * sum(len((r["text"] or "").split()) for r in rows), rel_tol=0.5)


def test_shards_of_the_mix(kept):
    check(kept["sharding"], [r["text"] for r in kept["mixing"]], 24)


def test_rows_without_an_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [long, long, None, None], ids=[None, None, 3, 3])
    assert corpus_pipeline.near_duplicates(spark, docs, SF).count() == 2
    assert corpus_pipeline.without_benchmark(spark, docs, SF).count() == 4
    assert corpus_pipeline.mixed(spark, docs.withColumn("n_chars", F.lit(1)), SF).count() > 0
    assert decontamination.decontaminate(docs, docs.selectExpr("doc_id AS item_id", "text")).count() == 4


def test_rows_that_share_an_id(spark):
    copied, alone = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = documents(spark, [copied, copied, alone, alone], ids=[3, 5, 5, 5])
    for n in (1, 4, 7):
        rows = corpus_pipeline.near_duplicates(spark, docs.repartition(n), SF).collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == [(3, copied), (5, alone)]


def test_equal_rows_are_mixed_as_often_as_they_are_due(spark):
    texts = ["a b c"] * 10 + ["d e", "f", "", None, "", None]
    docs = documents(spark, texts, ids=[7] * 10 + [1, 2, 3, 3, None, None], sources=["s"] * 8 + ["t"] * 8)
    docs = docs.withColumn("digest", F.lit(0)).withColumn("shards", F.lit("clash"))
    due: dict = {}
    for r in mixing.mix_sources(docs.select("doc_id", "text", "source")).where("copies > 0").collect():
        due[r["doc_id"], r["source"], r["size"]] = due.get((r["doc_id"], r["source"], r["size"]), 0) + r["copies"]
    got: dict = {}
    for r in corpus_pipeline.mixed(spark, docs, SF).collect():
        key = (r["doc_id"], r["source"], len((r["text"] or "").split()))
        got[key] = got.get(key, 0) + 1
    assert got == due and sum(due.values()) > 10


def test_near_duplicates_deal_texts_of_a_large_group_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 20)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    texts = near_group(random.Random(11), 150, 300)
    dealt, inner = [], jaccard._links_of_clusters

    def counted(members, *rest):
        dealt.append(members.count())
        return inner(members, *rest)

    monkeypatch.setattr(jaccard, "_links_of_clusters", counted)
    left = corpus_pipeline.near_duplicates(spark, documents(spark, texts), SF).collect()
    first = {c for _, c in components(texts).values()}
    assert {r["doc_id"] for r in left} == first
    assert 0 < sum(dealt) < 8 * len(texts)
