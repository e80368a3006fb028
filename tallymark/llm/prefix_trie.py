"""Prefix trie of conversations: which openings are shared, by whom, and what sharing saves.

A prefix is known by a digest: the sum, in four lanes of 32 bits, of hashes of its turns and their
depths, so digests of long conversations come from block sums. A count-min sketch of all prefix
digests screens them: an estimate of one proves that a prefix belongs to one conversation, as do all
longer ones, and the nodes of that tail are emitted where they are. Only prefixes that may be shared
are shuffled and grouped exactly. Sums over subtrees come from the conversations that own nodes, as
suffix sums along their paths; no step goes through the depths one by one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import by_value
from tallymark.operators.ranking import carry_blocks, position_in_group
from tallymark.session import cut

LANES = 4
SKETCH_ROWS = 4
#: Counters of a sketch row: a power of two between these, at least 8 for each prefix up to 2^21 of them.
LEAST_WIDTH, MOST_WIDTH = 1 << 16, 1 << 24
PIECE = 1 << 16
BLOCK = 1024
#: Conversation ids that make one piece of a list of ids.
ID_SPAN = 4096
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def order_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """(conv_id, position, mark, chars): turns from 1, nulls first, then by role and digest of the text.

    Null roles and texts read as empty; rows without a conversation are left out. `mark` tells turns
    apart by role and text, so texts themselves are not shuffled.
    """
    who, said = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    mark = F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary"))
    told = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).isNotNull().alias("timed"),
        F.col(turn).alias("turn"), who.alias("role"), mark.alias("mark"),
        F.length(said).cast("bigint").alias("chars"))
    return position_in_group(told, ["conv_id"], ["timed", "turn", "role", "mark", "chars"]).select(
        "conv_id", "position", "mark", "chars")


def with_shared_openings(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, depth, mark, chars) of rebuilt conversations, with a row of depth 0 for each.

    The first crc32(id) mod `most` turns of a conversation are those of the one whose id is the next
    multiple of `every` towards zero.
    """
    turns = cut(turns)  # read four times below

    def own(conv_id: Column) -> Column:
        return F.crc32(conv_id.cast("string").cast("binary")) % most

    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    convs = turns.select("conv_id").distinct().withColumns({"base": base, "h": own(F.col("conv_id"))})
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("position") < most)).select(
        F.col("conv_id").alias("base"), F.col("position").alias("depth"), "mark", "chars")
    opened = convs.join(heads, "base").where(F.col("depth") <= F.col("h")).select(
        "conv_id", "depth", "mark", "chars")
    given = heads.groupBy("base").agg(F.count(F.lit(1)).alias("given"))
    rest = turns.withColumns({"base": base, "h": own(F.col("conv_id"))}).where("position > h").join(
        given, "base", "left").select(
        "conv_id", (F.col("position") - F.col("h") + F.least("h", F.coalesce("given", F.lit(0)))).alias("depth"),
        "mark", "chars")
    tops = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("mark"),
                        F.lit(0).cast("bigint").alias("chars"))
    return tops.unionByName(opened).unionByName(rest)


def _running(df: DataFrame, by: str, ordinal: str, sums: dict[str, str], totals: dict[str, str]) -> DataFrame:
    """Running sums along `ordinal` (own row included) and totals of a group, which no task holds whole."""
    keyed = df.withColumns({"__key": F.struct(by), "__block": F.floor(F.col(ordinal) / BLOCK)})
    block = ["__key", "__block"]
    sizes = keyed.groupBy(*block).agg(*[F.sum(c).alias(c) for c in {**sums, **totals}])
    carried = carry_blocks(sizes, sums={c: f"__before_{c}" for c in sums}, totals=totals)
    inside = Window.partitionBy(*block).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumns({out: F.sum(c).over(inside) for c, out in sums.items()})
    joined = local.join(carried, block)
    return joined.withColumns({
        out: F.col(out) + F.col(f"__before_{c}") for c, out in sums.items()
    }).drop(*block, *[f"__before_{c}" for c in sums])


def prefix_digests(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, n_turns, key, parent): the digest of every prefix and of the one before."""
    hashed = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), "mark").cast("binary"))
    lanes = {f"lane{i}": F.when(F.col("depth") > 0, F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10)
                                .cast("bigint")).otherwise(0) for i in range(LANES)}
    marked = paths.withColumn("hash", hashed).select(
        "conv_id", "depth", "chars", (F.col("depth") > 0).cast("bigint").alias("one"),
        *[c.alias(n) for n, c in lanes.items()])
    summed = _running(marked, "conv_id", "depth", {n: f"sum_{n}" for n in lanes}, {"one": "n_turns"})

    def digest(depth: Column, sums: list[Column]) -> Column:
        return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))

    here = [F.col(f"sum_{n}") for n in lanes]
    above = [F.col(f"sum_{n}") - F.col(n) for n in lanes]
    return summed.select(
        "conv_id", "depth", "chars", "n_turns", digest(F.col("depth"), here).alias("key"),
        F.when(F.col("depth") > 0, digest(F.col("depth") - 1, above)).alias("parent"))


def sketch_width(prefixes: int) -> int:
    width = LEAST_WIDTH
    while width < MOST_WIDTH and width < 8 * prefixes:
        width *= 2
    return width


def _cells(keys: pa.Array, width: int) -> np.ndarray:
    """A counter in each sketch row for digests of 16 bytes."""
    halves = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)
    step = halves[:, 1] | np.uint64(1)
    with np.errstate(over="ignore"):
        rows = [halves[:, 0] + np.uint64(r) * step for r in range(SKETCH_ROWS)]
    return np.stack([(r & np.uint64(width - 1)).astype(np.int64) for r in rows])


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((SKETCH_ROWS, width), np.uint8)
        for batch in batches:
            if batch.num_rows:
                for r, cells in enumerate(_cells(batch.column(0), width)):
                    cell, seen = np.unique(cells, return_counts=True)
                    counters[r, cell] = np.minimum(2, counters[r, cell] + np.minimum(seen, 2))
        flat = counters.reshape(-1, PIECE)
        for piece in np.flatnonzero(flat.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.int32()), pa.array([zlib.compress(flat[piece].tobytes(), 1)], pa.binary())],
                names=["piece", "counters"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(data), np.uint8)
            merged[piece] = np.minimum(2, merged[piece] + part) if piece in merged else part
    for piece, counters in merged.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([piece], pa.int32()), pa.array([np.packbits(counters >= 2).tobytes()], pa.binary())],
            names=["piece", "counters"])


def seen_twice(digests: DataFrame, width: int) -> np.ndarray:
    """Count-min sketch of `digests(key)` as bits: counters of two and more.

    Counters end at two, as more is never asked. A task has `SKETCH_ROWS * width` bytes; the bits that
    reach the driver are an eighth of that, 8 MB at most.
    """
    schema = "piece int, counters binary"
    pieces = digests.select("key").mapInArrow(_count(width), schema).repartition("piece").mapInArrow(_merge, schema)
    bits = np.zeros((SKETCH_ROWS * width // PIECE, PIECE // 8), np.uint8)
    for r in pieces.toLocalIterator():
        bits[r["piece"]] = np.frombuffer(r["counters"], np.uint8)
    return bits.reshape(SKETCH_ROWS, -1)


def screen(prefixes: DataFrame, bits: np.ndarray) -> DataFrame:
    """`prefixes` with `shared`: false where the estimate proves that one conversation has the prefix."""
    from pyspark.sql.types import BooleanType, StructField, StructType

    width = bits.shape[1] * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shared = batch.column(batch.schema.get_field_index("depth")).to_numpy() == 0
            least = np.ones(batch.num_rows, bool)
            for r, cells in enumerate(_cells(batch.column(batch.schema.get_field_index("key")), width)):
                least &= (bits[r, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shared | least)], names=[*batch.schema.names, "shared"])

    return prefixes.mapInArrow(run, StructType([*prefixes.schema.fields, StructField("shared", BooleanType())]))


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces():
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()

    for key, own in groupby(pieces(), lambda p: p[0]):
        digest, comma = hashlib.sha256(), ""
        for _, ids in own:
            digest.update((comma + ids).encode())
            comma = ","
        yield pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of `ends(key, conv_id)`: ids ascend and are joined by commas.

    Ids are joined in pieces of at most `ID_SPAN` first, which the tasks share; the pieces of a node
    then stream through one digest, which cannot be split.
    """
    span = F.floor(F.col("conv_id") / ID_SPAN).alias("span")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = ends.groupBy("key", span).agg(F.array_join(ids, ",").alias("ids"))
    return pieces.repartition("key").sortWithinPartitions("key", "span").select("key", "ids").mapInArrow(
        _id_digests, "key binary, ends_sha256 string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    `paths(conv_id, depth, mark, chars)` has a row for each turn from depth 1 on and one of depth 0 per
    conversation, which need not have turns. A row per distinct prefix: `conv_id` is its least member
    and names the node together with `depth`; the root has no parent. `saved_tokens` sums
    (members - 1) * `chars` over the subtree, `n_leaves` counts its nodes without children, and
    `ends_sha256` is the digest of the ids that end at the node. An empty table gives no rows.
    """
    # Written as they are: running sums read their input several times.
    prefixes = cut(prefix_digests(cut(paths)))
    below = prefixes.where("depth > 0")
    screened = screen(prefixes, seen_twice(below, sketch_width(below.count())))
    reach = screened.groupBy("conv_id").agg(
        F.min(F.when(~F.col("shared"), F.col("depth") - 1)).alias("reach"))
    known = cut(screened.drop("shared").join(reach, "conv_id").withColumn(
        "reach", F.coalesce("reach", "n_turns")))
    candidates = known.where("depth <= reach")

    ends_here, has_tail = F.col("depth") == F.col("n_turns"), F.col("n_turns") > F.col("reach")
    nodes = cut(candidates.groupBy("key", "parent", "depth", "chars").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.count_if(has_tail & (F.col("depth") == F.col("reach"))).alias("tails_here"),
        F.count_if(has_tail).alias("tails_below")))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("grouped"))
    full = cut(nodes.join(children, "key", "left").withColumn(
        "n_children", F.coalesce("grouped", F.lit(0)) + F.col("tails_here")))

    owned = full.select("conv_id", "depth", (F.col("n_children") == 0).cast("bigint").alias("leaf"),
                        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    owners = nodes.select("conv_id").distinct()
    along = cut(candidates.select("conv_id", "depth", "key").join(owners, "conv_id", "left_semi").join(
        owned, ["conv_id", "depth"], "left").fillna(0, ["leaf", "saved"]))
    summed = _running(along, "conv_id", "depth", {"leaf": "to_leaf", "saved": "to_saved"},
                      {"leaf": "all_leaf", "saved": "all_saved"})
    subtrees = summed.groupBy("key").agg(
        F.sum(F.col("all_leaf") - F.col("to_leaf") + F.col("leaf")).alias("leaves"),
        F.sum(F.col("all_saved") - F.col("to_saved") + F.col("saved")).alias("saved_tokens"))

    nothing = F.lit(hashlib.sha256().hexdigest())
    ends = end_digests(candidates.where(ends_here).select("key", "conv_id"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    grouped = full.join(subtrees, "key").join(ends, "key", "left").join(above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.col("tails_below")).alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))

    name = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    tail = known.where("depth > reach")
    first = tail.where("depth = reach + 1").join(above, "parent")
    later = tail.where("depth > reach + 1").withColumn("parent_conv_id", F.col("conv_id"))
    one = F.lit(1).cast("bigint")
    tails = first.unionByName(later).select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"),
        (~ends_here).cast("bigint").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"), F.when(ends_here, name).otherwise(nothing).alias("ends_sha256"))
    return grouped.unionByName(tails).select(*NODE)


#: The trie of rebuilt conversations in the other engine, prefixes as whole lists; the checksum of an id
#: is worked out bit by bit.
SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
    md5(coalesce(text, ''))) AS p, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (
  SELECT conv_id, list(x ORDER BY p) AS xs FROM t GROUP BY conv_id
), s AS (
  SELECT conv_id, xs, (list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT for i in range(8)],
    lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS c
  FROM l
), h AS (
  SELECT conv_id, xs, xor(c, 4294967295) % 6 AS h FROM s
), r AS (
  SELECT a.conv_id, list_concat(coalesce(b.xs, [])[1:a.h], a.xs[a.h + 1:]) AS xs
  FROM h a LEFT JOIN l b ON b.conv_id = a.conv_id - a.conv_id % 100
), n AS (
  SELECT conv_id, d, xs[1:d] AS k, d = len(xs) AS ends, CASE WHEN d > 0 THEN length(xs[d].t) ELSE 0 END AS chars
  FROM (SELECT conv_id, xs, unnest(range(0, len(xs) + 1)) AS d FROM r)
), g AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids
  FROM n GROUP BY k, d
), c AS (
  SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL
), f AS (
  SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c USING (k, d)
), u AS (
  SELECT f.d, f.conv_id AS owner, f.n_convs, f.chars, f.n_children, unnest(range(0, f.d + 1)) AS up, f.k FROM f
), v AS (
  SELECT k[1:up] AS k, up AS d, count(*) FILTER (n_children = 0) AS n_leaves,
    CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM u GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, v.n_leaves, v.saved_tokens,
  sha256(f.ids) AS ends_sha256
FROM f JOIN v USING (k, d) LEFT JOIN g a ON f.d > 0 AND a.d = f.d - 1 AND a.k = f.k[1:f.d - 1]
"""

by_value(__name__)
