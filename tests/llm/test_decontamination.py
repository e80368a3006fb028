import pytest

from tallymark.llm import decontamination
from tests.check_oracles import compare
from tests.llm.data import documents, near_copies

ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"),
    (3, "short ITEM"), (4, None), (5, ""), (None, "one two"), (6, "repeat repeat repeat"), (7, "é-Ü x9"),
]
TEXTS = [
    "x alpha, beta gamma delta epsilon zeta eta theta iota kappa lambda y", "a short, item! short item",
    "repeat repeat repeat repeat repeat", None, "", "alpha beta gamma", "é ü X9 É Ü x9",
    "beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 300, "item short", "then one two three",
]


@pytest.fixture
def con(spark):
    import duckdb
    con = duckdb.connect()

    def use(docs, items):
        con.register("documents", docs.toArrow())
        con.register("benchmark", items.toArrow())
        return con
    return use


def both(spark):
    texts = TEXTS + near_copies(groups=4)
    docs = documents(spark, texts, ids=[None if i == 3 else i for i in range(len(texts))])
    more = [(100 + i, t) for i, t in enumerate(texts[20:24])]
    return docs.repartition(5), spark.createDataFrame(ITEMS + more, "item_id bigint, text string")


@pytest.mark.parametrize("round_words", [2_000_000, 40])
def test_against_the_other_engine(spark, con, monkeypatch, round_words):
    monkeypatch.setattr(decontamination, "ROUND_WORDS", round_words)
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", 3000)
    docs, items = both(spark)
    found = decontamination.decontaminate(docs.withColumnRenamed("lang", "spans"), items)
    assert compare(decontamination.digest_columns(found), con(docs, items), decontamination.SQL) is None


def test_spans_and_proximity(spark):
    docs, items = both(spark)
    rows = {r["doc_id"]: r for r in decontamination.decontaminate(docs, items, slack=1).collect()}
    assert [tuple(s) for s in rows[0]["spans"]] == [(1, 12)] and rows[0]["items"] == [1]
    assert [tuple(s) for s in rows[1]["spans"]] == [(1, 5)] and rows[1]["items"] == [2, 3]
    assert rows[8]["items"] == [] and rows[8]["near"] == [2, 3]


def test_empty_tables(spark):
    docs, items = both(spark)
    assert decontamination.decontaminate(documents(spark, []), items).count() == 0
    none = decontamination.digest_columns(decontamination.decontaminate(docs, items.limit(0))).collect()
    assert len(none) == docs.count() and not any(r["contaminated"] for r in none)
