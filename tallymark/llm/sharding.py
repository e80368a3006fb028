"""Minimax contiguous sharding: the smallest shard capacity that ordered groups allow.

Groups of equal texts are atomic and ordered by a digest of the text. A binary search finds the smallest
capacity for which a greedy pass over the ordered groups needs no more than the wanted shards; the same
pass then cuts. The pass works on pieces: runs of groups that begin with the same digits of the digest,
at first `UNITS` of them at most. Where a cut may fall inside a piece, the piece is split by one more digit,
until cuts can only fall between groups; so the plan stays small at any size and its capacity is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import cut

#: First pieces and blocks of rows: the first hexadecimal digits of digests.
DIGITS = 3
UNITS = 16 ** DIGITS
SHARDS = 24
#: A document's fixed cost beside its bytes.
ROW_BYTES = 8
#: Equal rows that one task numbers.
RUN_ROWS = 1 << 20


def digest_of(text: Column) -> Column:
    """Digest of a text, null as empty; groups of equal texts stand in its order."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _greedy(sizes: Column, capacity: Column) -> Column:
    """(shards, fill) of a pass that starts a new shard where the next unit does not fit."""
    start = F.struct(F.lit(1).cast("bigint").alias("shards"), F.lit(0).cast("bigint").alias("fill"))
    return F.aggregate(sizes, start, lambda a, x: F.when(
        a.fill + x <= capacity, F.struct(a.shards.alias("shards"), (a.fill + x).alias("fill"))
    ).otherwise(F.struct((a.shards + 1).alias("shards"), x.alias("fill"))))


def minimax_capacity(sizes: Column, shards: int) -> Column:
    """Smallest capacity with which the greedy pass needs at most `shards` shards.

    At least the largest unit and the mean are needed; the mean plus the largest unit is always
    enough, so the search is between these.
    """
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    largest = F.coalesce(F.array_max(sizes), F.lit(0)).cast("bigint")
    mean = F.ceil(total / shards).cast("bigint")
    state = F.struct(F.greatest(largest, mean).alias("low"), (mean + largest).alias("high"))

    def halve(a: Column, _: Column) -> Column:
        middle = F.shiftright(a.low + a.high, 1)
        fits = _greedy(sizes, middle).shards <= shards
        return F.when(a.low >= a.high, a).otherwise(F.when(
            fits, F.struct(a.low.alias("low"), middle.alias("high"))
        ).otherwise(F.struct((middle + 1).alias("low"), a.high.alias("high"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), state, halve, lambda a: a.high)


def _pieces(rows: DataFrame, digits: int) -> DataFrame:
    """(prefix, bytes, whole): pieces of `rows(digest, size)`; `whole` ones are single groups."""
    return rows.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(
        F.sum("size").alias("bytes"), (F.min("digest") == F.max("digest")).alias("whole"))


def _planned(pieces: DataFrame, shards: int) -> DataFrame:
    """One row: the pieces in order, their sizes, the capacity that they need and the mean of a shard."""
    ordered = pieces.agg(F.sort_array(F.collect_list(F.struct("prefix", "bytes", "whole"))).alias("u"))
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return ordered.withColumn("sizes", F.transform("u", lambda x: x.bytes)).withColumns({
        "capacity": minimax_capacity(F.col("sizes"), shards), "total": total,
        "mean": F.ceil(total / shards).cast("bigint")})


def _to_split(pieces: DataFrame, shards: int, largest: int) -> DataFrame:
    """(prefix) of the pieces in which a cut may fall for a capacity that is still possible.

    Possible capacities are at least `largest`, the greatest group, and the mean, and at most what the
    pieces need. A pass cuts later the larger its capacity is and the finer its pieces are: the k-th cut is
    never before that of the least capacity over these pieces, rounded down to a piece, and never after k
    times the largest capacity. Pieces that no shard of least capacity could hold are split before all others.
    """
    placed = pieces.withColumn("start", F.coalesce(F.sum("bytes").over(
        Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marks = placed.agg(F.sort_array(F.collect_list("start"))).scalar()
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(shards - 1, 1))), F.array(F.lit(0).cast("bigint")),
        lambda all, _: F.array_append(all, F.array_max(F.filter(
            "starts", lambda s: s <= F.element_at(all, -1) + F.col("least")))))
    bounds = _planned(pieces, shards).select(
        "capacity", F.greatest(F.col("mean"), F.lit(largest)).alias("least")).withColumn("starts", marks).select(
        F.struct("capacity", "least", F.slice(walk, 2, shards).alias("earliest"))).scalar()
    open_pieces = placed.where(~F.col("whole")).withColumn("b", bounds).where("b.capacity > b.least")
    may_cut = F.exists(F.transform("b.earliest", lambda at, k: (
        F.col("start") < (k + 1) * F.col("b.capacity")) & (F.col("start") + F.col("bytes") > at)), lambda x: x)
    found = open_pieces.select("prefix", (F.col("bytes") > F.col("b.least")).alias("oversized"), may_cut.alias("may_cut"))
    first = found.agg(F.coalesce(F.bool_or("oversized"), F.lit(False))).scalar()
    return found.withColumn("first", first).where(
        (F.col("oversized") | F.col("may_cut")) & (F.col("oversized") == F.col("first"))).select("prefix")


def plan_cuts(rows: DataFrame, shards: int) -> DataFrame:
    """One row (capacity, cuts): the smallest capacity and where shards after the first begin.

    `rows(digest, size)`. A cut is the beginning of a digest. Pieces are at most `UNITS` and what is split
    beside some hundred cuts; a round is one aggregate over the rows of the pieces that it splits.
    """
    pieces = cut(_pieces(rows, DIGITS))
    mean = _planned(pieces, shards).select("mean").first()[0] or 0

    def under(split: DataFrame, digits: int) -> DataFrame:
        return rows.join(F.broadcast(split), F.substring("digest", 1, digits) == F.col("prefix"), "left_semi")

    # A group above the mean stands in a piece above the mean: fewer pieces than shards.
    large = pieces.where(F.col("bytes") > mean).select("prefix")
    largest = under(large, DIGITS).groupBy("digest").agg(F.sum("size").alias("bytes")).agg(
        F.max("bytes")).first()[0] or 0
    while True:
        split = cut(_to_split(pieces, shards, largest))
        lengths = [r[0] for r in split.select(F.length("prefix")).distinct().collect()]
        if not lengths:
            return _planned(pieces, shards).select("capacity", _cuts().alias("cuts"))
        finer = [_pieces(under(split.where(F.length("prefix") == n), n), n + 1) for n in lengths]
        kept = pieces.join(F.broadcast(split), "prefix", "left_anti")
        pieces = cut(reduce(DataFrame.unionByName, finer, kept))


def _cuts() -> Column:
    """Prefixes of the pieces at which the greedy pass with `capacity` begins a new shard."""
    start = F.struct(F.lit(0).cast("bigint").alias("fill"), F.array().cast("array<string>").alias("cuts"))
    return F.aggregate("u", start, lambda a, x: F.when(
        a.fill + x.bytes <= F.col("capacity"),
        F.struct((a.fill + x.bytes).alias("fill"), a.cuts.alias("cuts"))
    ).otherwise(F.struct(x.bytes.alias("fill"), F.array_append(a.cuts, x.prefix).alias("cuts"))),
        lambda a: a.cuts)


def _numbered(runs: DataFrame) -> DataFrame:
    """A row for each of `n` equal rows, `slot` counting on from `first`; long runs are shared by tasks."""
    def rows(df: DataFrame, first: Column, n: Column) -> DataFrame:
        return df.select("doc_id", "size", "text_crc32", "shard", "capacity",
                         F.explode(F.sequence(first, first + n - 1)).alias("slot"))

    short = rows(runs.where(F.col("n") <= RUN_ROWS), F.col("first"), F.col("n"))
    parts = runs.where(F.col("n") > RUN_ROWS).withColumn("part", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN_ROWS)))).repartition("shard", "first", "part")
    done = F.col("part") * RUN_ROWS
    return short.unionByName(rows(parts, F.col("first") + done, F.least(F.lit(RUN_ROWS).cast("bigint"), F.col("n") - done)))


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity), one row per row.

    Shards are near equal in bytes: none holds more than the smallest feasible `capacity`.
    Slots number the rows of a shard from 0 without gaps. A null text counts as an empty one.
    Repeated rows and repeated or null ids are rows like any other and get slots of their own;
    equal rows are interchangeable. An empty table gives no rows.

    Rows are numbered in blocks by the first digits of the digest and a salt, about the square root of the
    different rows under these digits, and equal rows travel as one row with a count; so neither a text nor a
    row with a third of the table is numbered by one task.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    slim = cut(docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(content).cast("bigint").alias("text_crc32"), digest_of(F.col(text)).alias("digest")))
    # One value: a number and as many texts as there are shards.
    plan = cut(plan_cuts(slim, shards)).select(F.struct("capacity", "cuts")).scalar()
    unit = F.conv(F.substring("digest", 1, DIGITS), 16, 10).cast("int")
    runs = cut(slim.groupBy("doc_id", "size", "text_crc32", "digest").agg(
        F.count(F.lit(1)).alias("n")).withColumn("plan", plan).select(
        "doc_id", "size", "text_crc32", unit.alias("unit"), "n", "plan.capacity",
        F.size(F.filter("plan.cuts", lambda c: c <= F.col("digest"))).alias("shard")))
    group = ["shard", "unit"]
    sizes = runs.groupBy(*group).agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    # At most UNITS rows of four numbers, and one more for each cut.
    begins = sizes.select(*group, F.ceil(F.sqrt("runs")).alias("salts"),
                          F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("unit_start"))
    salted = runs.join(F.broadcast(begins), group).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("salts")).cast("int"))
    block = [*group, "salt"]
    before = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*block).agg(F.sum("n").alias("rows")).select(
        *block, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("salt_start"))
    inside = Window.partitionBy(*block).orderBy("doc_id", "size", "text_crc32").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = salted.withColumn("row", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, block).withColumn(
        "first", (F.col("unit_start") + F.col("salt_start") + F.col("row")).cast("bigint"))
    return _numbered(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "capacity")
