from pyspark.sql import functions as F

from tallymark.llm.samples import labelled_sample
from tests.llm.data import documents


def test_the_bound_is_one_of_rows(spark):
    ids = [*range(40), *[99] * 30, None]
    docs = documents(spark, [f"text {i}" for i in range(len(ids))], ids=ids)
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(0, 40, 2), 99, 1000]] + [(None, 1), (3, None)], "doc_id bigint, toxic int")

    def taken(bound):
        return sorted(r["doc_id"] for r in labelled_sample(docs, labels, "toxic", bound).collect())

    assert taken(100) == [*range(0, 40, 2), *[99] * 30]
    assert taken(25) == [*range(0, 40, 2)]
    assert len(taken(7)) <= 7 and taken(7) == taken(7)
    assert labelled_sample(docs, labels, "toxic", 100, F.col("label") == 1).count() == 30
    assert labelled_sample(docs.limit(0), labels, "toxic", 100).count() == 0
