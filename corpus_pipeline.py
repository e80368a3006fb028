"""Corpus pipeline: quality, near duplicates, benchmark passages, mixing, shards.

`STAGES` are functions of (spark, docs, sf_dir); each reads all rows that its predecessor kept. `run`
writes every stage as Parquet to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontamination, jaccard, mixing, quality, sharding
from tallymark.llm.queries import ORACLES as LLM_ORACLES
from tallymark.llm.queries import QUERIES as LLM_QUERIES
from tallymark.session import load, shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _digest(text: str = "text") -> Column:
    """128 bits of a text; null is told from empty."""
    return F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    judged = quality.judge_quality(docs, model, list(COLUMNS))
    return judged.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one with the least id, then the least digest.

    Documents are told apart by id and 128 bits of their text, so different texts with one id stay unless
    they are linked; of repeated rows one stays. Documents without an id have a negative one made from
    their text. Null and empty texts link with nothing and all stay, one per id.
    """
    stand_in = -1 - F.shiftrightunsigned(F.xxhash64("text"), 1)
    rank = F.struct(F.coalesce("doc_id", stand_in).alias("id"), _digest().alias("digest"))
    told = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("__key"), rank.alias("__rank"))
    groups = jaccard.jaccard_components(told, doc_id="__key").select(
        F.col("doc_id").alias("__key"), "component_id").distinct()
    first = told.select("__key", "__rank").distinct().join(groups, "__key").groupBy(
        "component_id").agg(F.min_by("__key", "__rank").alias("__key")).select("__key")
    row = F.struct(*[c for c in COLUMNS if c != "text"], "text")
    return told.join(first, "__key", "left_semi").groupBy("__key", "__rank").agg(
        F.min(row).alias("row")).select(*[f"row.{c}" for c in COLUMNS])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = decontamination.decontaminate(docs, load(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("spans") > 0).select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    same = (F.xxhash64("text") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return docs.select(*COLUMNS).join(hit, same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mix has placed in a shard.

    Rows are told apart by id, source and 128 bits of their text; the copies of equal rows are counted
    together. Null ids, sources and texts are values like any other. The rows of a partition stand by
    shard and, within it, in the order of the local shuffle.
    """
    key = ["doc_id", "source", "digest"]
    told = docs.select(*COLUMNS, _digest().alias("digest"))
    taken = mixing.mix_sources(told, carry=("digest",)).where("copies > 0").groupBy(*key).agg(
        F.flatten(F.collect_list("shards")).alias("__shards"), F.min("local_key").alias("__order"))
    named = taken.select(F.struct(*key).alias("__key"), "__shards", "__order")
    return told.dropDuplicates(key).withColumn("__key", F.struct(*key)).join(named, "__key").select(
        *COLUMNS, "__order", F.explode("__shards").alias("__shard")
    ).sortWithinPartitions("__shard", "__order").select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", quality_rules), ("near_duplicates", near_duplicates),
    ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded),
]
#: The quality model is fitted, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {**LLM_QUERIES, "pipeline": run}
ORACLES = {**LLM_ORACLES, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
