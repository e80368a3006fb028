"""Quality rules: counts and thresholds, and boosted trees over document statistics.

Every whole text is judged once, in a task that returns its counts and the trees' score. The trees are
fitted on all labelled documents, whose sums are made by tasks, and scored from flat node arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm import boosting
from tallymark.llm.common import by_value
from tallymark.llm.quantiles import quantiles
from tallymark.llm.samples import fold_of, map_rows
from tallymark.session import cut

#: Fixed values of the base rules: fewest words, largest share of repeated words, symbols.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Of the held-out good documents that pass the base rules, this share has to be kept.
KEEP_RECALL = 0.998

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "capitals", "pipes",
            "shouts", "digits", "distinct_words", "words_per_line", "top_word")
#: The score may only fall as these grow.
MONOTONE = {FEATURES.index(f): -1 for f in ("symbols", "dup_lines", "repeat_words", "shouts", "top_word")}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNT_SCHEMA = ", ".join(f"{c} bigint" for c in COUNTS)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in windows of three that occur twice or more; `ids` number the words of a text."""
    if len(ids) < 3:
        return 0
    pairs, radix = ids[:-2] * distinct + ids[1:-1], distinct
    if distinct > 1_000_000:  # three numbers would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    codes = pairs * radix + ids[2:]
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift:shift + len(twice)] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """Counts and features of one whole text; a null is an empty text."""
    text = text or ""
    words = text.encode().split()  # bytes split at ASCII blanks only
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(ids, len(numbers))
    capitals = _capitals(text)
    per_word = 1.0 / max(n, 1)
    features = [
        math.log1p(n), word_chars * per_word, symbols * per_word, dup_lines / max(len(lines), 1),
        repeats * per_word, capitals / max(word_chars, 1), text.count("|") * per_word,
        text.count("!") * per_word, sum(map(text.count, "0123456789")) / max(word_chars, 1),
        len(numbers) * per_word, n / max(len(lines), 1),
        float(np.bincount(ids).max()) * per_word if n else 0.0,
    ]
    return [n, word_chars, symbols, dup_lines, repeats], features


def _capitals(text: str) -> int:
    """Characters that lower case changes; lengths are compared where it changes them."""
    lowered = text.lower()
    if len(lowered) != len(text):
        return sum(c != c.lower() for c in text)
    if text.isascii():
        a = np.frombuffer(text.encode(), np.uint8)
        return int(((a >= 65) & (a <= 90)).sum())
    a = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    b = np.frombuffer(lowered.encode("utf-32-le"), np.uint32)
    return int((a != b).sum())


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > 100 * MOST_REPEATED * n_words)


@dataclass
class Model:
    trees: boosting.Trees
    threshold: float


def labelled_features(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(held, features, good, weight) of the labelled documents that pass the base rules.

    `weight` is the number of labels of the id, `good` of those above 0; a row per document, however many
    labels it has. Statistics come first, so that no text is shuffled. Rows without an id or a label are no labels.
    """
    value = F.col(label).cast("int")
    known = labels.where(F.col("doc_id").isNotNull() & value.isNotNull()).groupBy(
        F.col("doc_id").alias("__id")).agg(F.count_if(value > 0).alias("good"), F.count(F.lit(1)).alias("weight"))

    def make():
        def judge(texts):
            made = [statistics(t) for t in texts]
            return {"n_words": [c[0] for c, _ in made], "n_repeat_words": [c[4] for c, _ in made],
                    "features": [f for _, f in made]}
        return judge

    measured = map_rows(docs, ["doc_id"], "text", "n_words bigint, n_repeat_words bigint, features array<double>", make)
    return measured.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(
        known, F.col("doc_id") == F.col("__id")).select(
        (fold_of(F.col("doc_id")) == 0).alias("held"), "features", "good", "weight")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Trees from all labelled documents outside the held-out fold, and the threshold that fold sets.

    Only sums over documents and quantiles reach the driver. Without labels of both kinds all documents that
    pass the base rules are kept.
    """
    rows = cut(labelled_features(docs, labels, label))
    learn = rows.where(~F.col("held"))
    good, weight = learn.agg(F.sum("good"), F.sum("weight")).first()
    if not good or good == weight:
        return Model(boosting.fit(np.zeros((0, len(FEATURES))), np.zeros(0), MONOTONE, trees=1), 0.0)
    trees = boosting.fit_rows(learn, len(FEATURES), MONOTONE)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(x), np.int32)), pa.array(trees.probability(x)), batch.column(1)],
                names=["series", "value", "weight"])

    scored = rows.where(F.col("held") & (F.col("good") > 0)).select("features", "good").mapInArrow(
        judge, "series int, value double, weight bigint")
    least = quantiles(scored, [1 - KEEP_RECALL])
    return Model(trees, min(0.5, float(least[0][0])) if least else 0.5)


def judge_quality(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of `docs` with the counts, `base_failed`, `score` and `kept`.

    Null and empty texts have no words and fail the base rules. Rows are judged one by one: repeated
    rows get equal verdicts. Columns of `docs` outside `keep` are not read.
    """
    trees, threshold = model.trees, model.threshold

    def make():
        def judge(texts):
            made = [statistics(t) for t in texts]
            counts = np.array([c for c, _ in made], dtype=np.int64)
            score = trees.probability(np.array([f for _, f in made], dtype=float))
            failed = base_failed(counts[:, 0], counts[:, 4])
            return dict(zip(COUNTS, counts.T.tolist(), strict=True)) | {
                "base_failed": failed.tolist(), "score": score.tolist(),
                "kept": (~failed & (score >= threshold)).tolist()}
        return judge

    return map_rows(docs, keep, text,
                    f"{COUNT_SCHEMA}, base_failed boolean, score double, kept boolean", make)


by_value(__name__)
