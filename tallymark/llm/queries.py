"""Registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import (
    chat, decontamination, jaccard, licenses, line_dedup, mixing, prefix_trie, quality,
    repair, secret_scan, sharding, toxicity, urls,
)
from tallymark.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_chat_format")
def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.with_tool_use(load(spark, sf_dir, "conversations")))


@query("op2_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out_column(F.col("doc_id")).alias("held_out"),
                         "score", "predicted")


@query("op3_url_filters")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit(urls.labelled_urls(spark))
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, model).select(
        "page_id", "host", "path", "rule", "verdict", "score")


@query("op4_secret_scan")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = secret_scan.fit(secret_scan.labelled_findings())
    return secret_scan.find_secrets(load(spark, sf_dir, "documents"), network, ["doc_id"])


@query("op5_decontamination", decontamination.SQL)
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(
        load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return decontamination.digest_columns(found)


@query("op6_jaccard_join", jaccard.SQL)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(load(spark, sf_dir, "documents"))


@query("op7_mixing", mixing.SQL)
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op8_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, model, ["doc_id"])


@query("op9_license_scan")
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.build_index(docs)).drop("matches")


@query("op10_sharding")
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents"))


@query("op11_prefix_trie", prefix_trie.SQL)
def shared_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.order_turns(load(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_openings(turns))


@query("op12_line_dedup", line_dedup.SQL)
def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents"), ["doc_id"]).drop("keep")


@query("op13_conversation_repair")
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    found = repair.repair_conversations(repair.damage(rows))
    return repair.with_all_conversations(found, rows)
