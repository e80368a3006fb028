import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymark.llm import boosting, quality
from tallymark.llm.quantiles import quantiles


def test_quantiles_are_those_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(s, float(v), int(w)) for s in (0, 3) for v, w in zip(rng.integers(0, 40, 300) / 7, rng.integers(0, 4, 300))]
    rows += [(5, 1.5, 1), (6, 2.0, 0)]
    probabilities = [0.0, 0.002, 1 / 3, 0.5, 0.77, 1.0]
    found = quantiles(spark.createDataFrame(rows, "series int, value double, weight bigint").repartition(5), probabilities)
    assert sorted(found) == [0, 3, 5]
    for s, got in found.items():
        every = np.repeat([v for t, v, _ in rows if t == s], [w for t, _, w in rows if t == s])
        assert np.allclose(got, np.quantile(every, probabilities), rtol=0, atol=1e-12)


def test_trees_by_tasks_are_those_of_one_array(spark, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    rng = np.random.default_rng(1)
    x = np.round(rng.random((600, 3)), 2)
    weight = rng.integers(1, 4, 600)
    good = np.where(x[:, 0] + 0.3 * rng.random(600) < 0.6, weight, 0)
    good[:20] = weight[:20] // 2
    rows = spark.createDataFrame([(a.tolist(), int(g), int(w)) for a, g, w in zip(x, good, weight)],
                                 "features array<double>, good bigint, weight bigint").repartition(7)
    got = boosting.fit_rows(rows, 3, {0: -1}, trees=4)
    y = np.concatenate([[1.0] * g + [0.0] * (w - g) for g, w in zip(good, weight)])
    want = boosting.fit(np.repeat(x, weight, axis=0), y, {0: -1}, trees=4)
    assert (got.feature == want.feature).all() and np.allclose(got.threshold, want.threshold)
    assert np.allclose(got.value, want.value) and np.isclose(got.start, want.start)


def test_labels_beyond_any_sample_are_learned(spark):
    """The bad documents are the last 400 in the order of the hash that a sample of 20 000 rows went by."""
    place = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    docs = spark.range(20_500).withColumnRenamed("id", "doc_id").withColumn("bad", place > 20_100).select(
        "doc_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(
            F.lit("w"), i.cast("string"), F.when(F.col("bad"), "!|").otherwise(""))), " ").alias("text"),
        (~F.col("bad")).cast("int").alias("quality"))
    labels = docs.select("doc_id", "quality")
    kept = quality.judge_quality(docs, quality.fit(docs, labels), ["doc_id", "quality"]).groupBy(
        "quality", "kept").count().collect()
    assert sorted(tuple(r) for r in kept) == [(0, False, 400), (1, True, 20_100)]


def test_repeated_labels_weigh_and_make_no_pairs(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20), (1, "x y z w " * 20), (2, "v" * 9), (None, "q " * 60)], "doc_id bigint, text string")
    docs = docs.withColumn("text", F.array_join(F.transform(F.split(F.trim("text"), " "), lambda w, i: F.concat(w, i.cast("string"))), " "))
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 2), (1, None), (None, 1), (2, 1)], "doc_id bigint, quality int")
    assert [(r["good"], r["weight"]) for r in quality.labelled_features(docs, labels, "quality").collect()] == [(2, 3)] * 2
