"""Bounded samples of labelled rows and row-wise Arrow passes over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import by_value


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int,
                    where: Column | None = None, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled rows, the same ones in every run.

    Ids are taken in the order of a hash, those of fewer rows first, until the next one's rows would pass
    the bound, so an id that many rows share cannot fill the sample. Ids and row counts are at most `bound`
    rows of numbers; they are broadcast and no text is shuffled. Rows without an id or a label are no labels.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("__id").isNotNull() & F.col("label").isNotNull())
    if where is not None:
        known = known.where(where)
    order = [F.xxhash64("__id"), F.col("__id"), F.col("label")]
    first = known.orderBy(*order).limit(bound)
    rows = docs.select(F.col(doc_id).alias("__id")).join(
        F.broadcast(first.select("__id").distinct()), "__id").groupBy("__id").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("n", *order).rowsBetween(Window.unboundedPreceding, 0)
    chosen = first.join(rows, "__id").withColumn("upto", F.sum("n").over(upto)).where(
        F.col("upto") <= bound).select("__id", "label")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("__id")).drop("__id")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """Fold of a document: the checksum of its id as text, modulo `folds`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def map_rows(df: DataFrame, keep: list[str], text: str, schema: str,
             make: Callable[[], Callable[[list], dict[str, list]]]) -> DataFrame:
    """Columns `keep` of `df` with columns that a function makes of each batch of texts.

    `make()` runs once per task and returns a function from a list of texts (null: None) to lists of
    results by column. `schema` is the DDL of those columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    source = df.select(*keep, F.col(text).alias("__text"))
    result = StructType([*source.schema.fields[:-1], *added.fields])
    fields = [(f.name, to_arrow_schema(StructType([f])).field(0).type) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = judge(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *[pa.array(made[n], t) for n, t in fields]],
                    names=[*part.schema.names[:-1], *[n for n, _ in fields]])

    return source.mapInArrow(run, result)


by_value(__name__)
