"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt to blocks by a hash, about the square root of its documents to a
block. What the mix takes of a source is whole rounds over all its blocks and then a prefix of one
more round, cut inside one block, so that the words taken meet the target. The block draws of all
sources are split among output shards by halving: each node gives its first child a draw without
replacement from its blocks of all sources. A source's draws then fill its quotas of the shards in a
permuted order, and `local_key` orders the rows of a shard. What is taken is counted from the copies
that the tree has placed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import BLANK_WORD
from tallymark.operators.ranking import left_join_null_safe
from tallymark.session import cut

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most often a source may be taken.
SHARE, MOST = 1.5, 2
#: Depth of the splitting tree: 2 ** LEVELS output shards.
LEVELS = 3
LEAST_BLOCKS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, quota, blocks): one row per source of (source, size).

    Filling by weight up to a cap and sharing the excess anew ends where every target is the lesser
    of its cap and one common level times its weight; the level is found on the sources in the order
    in which they reach their caps. `whole` rounds are taken of all documents and `quota` words more.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                       F.count(F.lit(1)).alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = (
        sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
        .withColumns({
            "full": F.coalesce(F.sum("cap").over(
                by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "open": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
            "wanted": F.sum("source_size").over(everything) * SHARE,
        })
        .withColumn("level", (F.col("wanted") - F.col("full")) / F.col("open"))
    )
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    target = F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight"))
    whole = F.when(F.col("source_size") > 0,
                   F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        ranked.withColumn("common", F.coalesce(F.max(holds).over(everything), F.lit(0.0)))
        .withColumn("target", target).withColumn("whole", whole.cast("bigint"))
        .select(
            "source", "source_size", "target", "whole",
            F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5)
            .cast("bigint").alias("quota"),
            F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.sqrt("docs"))).cast("bigint").alias("blocks"))
    )


def split_draws(draws: DataFrame, levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """(source_no, draw, shard) from (source_no, draws): quotas of the output shards, drawn exactly.

    The blocks of all sources are unit tokens of one pool. Every node of the tree sends half of its
    tokens, drawn without replacement, to its first child; the number by source is then a
    multivariate hypergeometric draw. Draws of a source are numbered by shard. The pool has about
    the square root of the documents as rows.
    """
    tokens = draws.where(F.col("draws") > 0).select(
        "source_no", F.explode(F.sequence(F.lit(1), F.col("draws").cast("int"))).alias("token")
    ).withColumn("shard", F.lit(0))
    for level in range(levels):
        chance = F.xxhash64(F.lit(seed), F.lit(level), "source_no", "token")
        node = Window.partitionBy("shard")
        tokens = tokens.withColumn("rank", F.row_number().over(
            node.orderBy(chance, "source_no", "token"))
        ).withColumn("half", F.ceil(F.count(F.lit(1)).over(node) / 2)).select(
            "source_no", "token",
            (F.col("shard") * 2 + (F.col("rank") > F.col("half")).cast("int")).alias("shard"))
    quota_order = Window.partitionBy("source_no").orderBy("shard", "token")
    return tokens.select("source_no", "shard", F.row_number().over(quota_order).alias("draw"))


def mix_sources(docs: DataFrame, levels: int = LEVELS, seed: int = 0, doc_id: str = "doc_id",
                text: str = "text", source: str = "source",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, shards, local_key), a row per row.

    `copies` is how often the mix takes the document, `shards` the output shard of each copy, `taken`
    the words of the copies with a shard. A null text is empty; a null source is a source, the last one.
    Documents without words count as taken where the draw passes them, and add nothing. Repeated
    rows and ids are rows like any other. An empty table gives no rows. Runs agree: every draw is a
    hash of ids and `seed`. Columns named in `carry` are kept under their names, and order rows of one id
    and size.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    sized = cut(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"),
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").alias("key"), *carry))
    targets = cut(source_targets(sized).withColumn(
        "source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    dealt = left_join_null_safe(
        sized, targets.select("source", "source_no", "blocks"), ["source"]
    ).withColumn("block", F.col("key") % F.col("blocks"))

    block = ["source_no", "block"]
    earlier = Window.partitionBy("source_no").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    known = targets.select("source_no", "source_size", "target", "whole", "quota")
    starts = dealt.groupBy(*block).agg(F.sum("size").alias("words")).select(
        *block, F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("block_start")
    ).join(known, "source_no")

    rounds = F.col("whole") + (F.col("block_start") <= F.col("quota")).cast("int")
    units = starts.where(rounds > 0).select(
        *block, F.explode(F.sequence(F.lit(1), rounds.cast("int"))).alias("round"))
    permuted = Window.partitionBy("source_no").orderBy(
        F.xxhash64(F.lit(seed), "source_no", "block", "round"), "block", "round")
    drawn = units.withColumn("draw", F.row_number().over(permuted))
    quotas = split_draws(units.groupBy("source_no").agg(F.count(F.lit(1)).alias("draws")),
                         levels, seed)
    placed = drawn.join(quotas, ["source_no", "draw"]).groupBy(*block).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("round", "shard"))),
                    lambda x: x.shard).alias("block_shards"))
    facts = starts.join(placed, block, "left")

    inside = Window.partitionBy(*block).orderBy("key", "doc_id", "size", *carry).rowsBetween(
        Window.unboundedPreceding, -1)
    before = F.col("block_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = (2 * F.col("before") + F.col("size") <= 2 * F.col("quota")).cast("int")
    return (
        dealt.join(facts, block).withColumn("before", before)
        .withColumn("copies", (F.col("whole") + extra).cast("bigint"))
        .withColumn("shards", F.coalesce(F.slice("block_shards", F.lit(1), F.col("copies").cast("int")),
                                         F.array().cast("array<int>")))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.size("shards") * F.col("size")).cast("bigint").alias("taken"), "shards",
            F.xxhash64(F.lit(seed), "doc_id").alias("local_key"), *carry)
    )


#: `mix_sources` in the other engine, without shards.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS key
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, 2 * source_size AS cap,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
    1.5::DOUBLE * sum(source_size) OVER () AS wanted
  FROM sums
), levelled AS (
  SELECT *, (wanted - filled) / open AS level FROM ranked
), common AS (
  SELECT coalesce(max(level) FILTER (level * weight <= cap), 0) AS common FROM levelled
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, common * weight) AS target,
         greatest(16, CAST(ceil(sqrt(docs)) AS BIGINT)) AS blocks
  FROM levelled, common
), quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM targets
), placed AS (
  SELECT s.doc_id, s.size, q.source_size, q.target, q.whole,
         CAST(floor(q.target - q.whole * q.source_size + 0.5) AS BIGINT) AS quota,
         coalesce(sum(s.size) OVER (PARTITION BY s.source
           ORDER BY s.key % q.blocks, s.key, s.doc_id NULLS FIRST, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN 2 * before + size <= 2 * quota THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""
