import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import boosting, quality
from tallymark.llm.samples import fold_of
from tests.llm.data import documents, near_copies

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(repeated)]


def test_counts_against_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a\x1cb c\u00a0d", "x\nx\n\nx \n x", "a b c a b c", "a a a a", "é|#$ É!!\r\né|#$ É!!"]
    texts += ["".join(rng.choice("ab \n#\t") for _ in range(200)) for _ in range(40)]
    texts += [t for t in near_copies(groups=3)[:30]]
    for t in texts:
        assert quality.statistics(t)[0] == brute(t)


def test_many_distinct_words(monkeypatch):
    ids = np.array([5, 6, 7, 5, 6, 7, 8])
    assert quality.repeated_words(ids, 9) == quality.repeated_words(ids, 1_500_000) == 6


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.3 * rng.random(800) < 0.6).astype(float)
    trees = boosting.fit(x, y, {0: -1}, trees=20)

    def walk(row):
        total = trees.start
        for t in range(len(trees.feature)):
            node = 0
            while node < 2 ** trees.depth - 1:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.threshold[t, node])
            total += trees.value[t, node - (2 ** trees.depth - 1)]
        return total

    assert np.allclose(trees.logits(x[:50]), [walk(r) for r in x[:50]])
    for row in x[:60]:
        line = np.tile(row, (30, 1))
        line[:, 0] = np.linspace(0, 1, 30)
        assert (np.diff(trees.logits(line)) <= 1e-12).all()
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.85


def test_held_out_accuracy_and_edge_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    judged = quality.judge_quality(docs, model, ["doc_id"])
    held = judged.join(labels, "doc_id").where((fold_of(F.col("doc_id")) == 0) & ~F.col("base_failed"))
    right = held.agg(F.avg(((F.col("quality") > 0) == F.col("kept")).cast("int"))).first()[0]
    assert right > 0.95
    odd = quality.judge_quality(documents(spark, [None, "", "a " * 70_000], ids=[None, 1, 1])
                                .withColumnRenamed("lang", "kept"), model, ["doc_id"]).collect()
    assert [r["base_failed"] for r in odd] == [True, True, True] and not any(r["kept"] for r in odd)
    assert quality.judge_quality(documents(spark, []), model, ["doc_id"]).count() == 0


def test_no_labels(spark):
    docs = documents(spark, ["good words here " + " ".join(f"w{i}" for i in range(80))])
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.judge_quality(docs, quality.fit(docs, labels), ["doc_id"]).first()["kept"]
