"""Small rows for the tests: nulls, empty and long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, texts, ids=None, sources=None):
    ids = ids if ids is not None else range(len(texts))
    sources = sources or [f"src{i % 3}" for i in range(len(texts))]
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, SCHEMA)


def near_copies(seed=3, groups=12):
    """Texts with copies, near copies, a passage that many share, and odd ones."""
    rng = random.Random(seed)
    passage = words(rng, 30)
    texts = []
    for g in range(groups):
        base = words(rng, rng.randrange(30, 120)).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
            if rng.random() < 0.4:
                copy += passage.split()
            texts.append(" ".join(copy))
    big = words(rng, 80).split()
    for k in range(70):  # a large group of near copies
        copy = list(big)
        copy[k] = f"y{k}"
        texts.append(" ".join(copy))
    texts += ["", None, "   ", "one", "ONE", "one two", "a b c d e", "A  b\tc d e", "a b c d e a b c d e a",
              "a b c d e a b c d e a b", words(rng, 6000)]
    return texts
