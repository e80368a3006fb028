import random

from pyspark.sql import functions as F

from tallymark.llm import toxicity
from tests.llm.data import documents

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_distances():
    rng = random.Random(2)
    terms = [("idiot", False), ("scum", False), ("moron", False), ("lowei", True), ("idiom", False)]
    trie = toxicity.Trie.of(terms)
    tried = ["", "idiot", "idot", "idiiot", "xidiot", "idiott", "scum", "scm", "loweixyz", "lowe", "loweix"]
    for _ in range(3000):
        word = list(rng.choice(terms)[0])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randrange(2)] = rng.choice(["", "a", "o"])
        tried.append("".join(word))
    for word in tried:
        want = []
        for i, (term, stem) in enumerate(terms):
            d = distance(word, term)
            if stem:
                want += [(0, i)] * word.startswith(term)
            elif d == 0 or d == 1 and len(term) >= toxicity.FUZZY_SIZE:
                want.append((d, i))
        assert trie.match(word) == min(want, default=None), word


def test_quotation_counts_apart():
    matcher = toxicity.Matcher([("idiot", False)])
    at = toxicity.FEATURES.index
    said = toxicity.describe('he wrote "you idiot" in a letter', matcher, [1.0])
    curly = toxicity.describe("he wrote “you idiot” in a letter", matcher, [1.0])
    assert curly == said
    meant = toxicity.describe("you idiot in a letter", matcher, [1.0])
    assert said[at("quoted")] > 0 and said[at("exact")] == 0
    assert meant[at("quoted")] == 0 and meant[at("exact")] > 0
    assert toxicity.describe(None, matcher, [1.0]) == toxicity.describe("", matcher, [1.0]) == [0.0] * 7


def test_held_out_accuracy_and_edge_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_documents(docs, model, ["doc_id"]).join(labels, "doc_id")
    held = scored.where(toxicity.held_out_column(F.col("doc_id")))
    right = held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.93
    odd = toxicity.score_documents(documents(spark, [None, "", "a " * 50_000, "x", "x"], ids=[None, 1, 1, 2, 2]),
                                   model, ["doc_id"]).collect()
    assert len({r["score"] for r in odd}) == 1 and len(odd) == 5
    assert toxicity.score_documents(documents(spark, []), model, ["doc_id"]).count() == 0


def test_no_labels(spark):
    docs = documents(spark, ["some words"])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert 0 <= toxicity.score_documents(docs, model, ["doc_id"]).first()["score"] <= 1
