"""Line deduplication: sorted ranges of line hashes, streamed, with a keep bitmap per document.

Every line that counts becomes a row (hash, document, position). The rows are range partitioned and
sorted by all of these, so a line that a third of all documents hold is shared by many tasks. Each
task streams its range and drops what does not belong to the first document of its hash; a row per
range tells the next one whether its first hash began earlier.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import by_value
from tallymark.session import cut

LEAST_CHARS = 10
#: Rows of a batch that a task hands on.
BATCH_ROWS = 1 << 16
SORTED = ("hi", "lo", "nameless", "doc")
LINES = "hi bigint, lo bigint, nameless boolean, doc bigint, row_key binary, position int"
EDGE = "part int, first_hi bigint, first_lo bigint, hi bigint, lo bigint, nameless boolean, doc bigint"
RESULT = "n_lines bigint, n_dropped bigint, keep binary, kept_sha256 string"


def line_key(line: bytes) -> bytes:
    """A line without the ASCII blanks at its ends, A-Z in lower case."""
    return line.strip().lower()


def _counts(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode()) >= least


def _line_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            hashes, rows, positions = [], [], []
            for r in range(batch.num_rows):
                text = texts[r].as_py()
                for p, line in enumerate(text.encode().split(b"\n")) if text else ():
                    key = line_key(line)
                    if _counts(key, least):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        rows.append(r)
                        positions.append(p)
                if len(rows) >= BATCH_ROWS or r == batch.num_rows - 1 and rows:
                    halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                    at = pa.array(rows, pa.int64())
                    doc = ids.take(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(halves[:, 0]), pa.array(halves[:, 1]), doc.is_null(), doc.fill_null(0),
                         keys.take(at), pa.array(positions, pa.int32())],
                        names=["hi", "lo", "nameless", "doc", "row_key", "position"])
                    hashes, rows, positions = [], [], []

    return run


def _runs(batches: Iterator[pa.RecordBatch], carried: tuple | None):
    """(batch, is in another document than the first of its hash, last run) of sorted batches."""
    last = carried  # (hi, lo, nameless, doc): hash of the run and the first document that holds it
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, nameless, doc = (
            batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in SORTED)
        starts = np.ones(len(hi), bool)
        starts[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        goes_on = last is not None and (hi[0], lo[0]) == last[:2]
        first = np.maximum.accumulate(np.where(starts, np.arange(len(hi)), 0))
        owner, owner_nameless = doc[first], nameless[first]
        if goes_on:
            same = first == 0
            owner, owner_nameless = np.where(same, last[3], owner), np.where(same, last[2], owner_nameless)
        last = (int(hi[-1]), int(lo[-1]), bool(owner_nameless[-1]), int(owner[-1]))
        yield batch, (doc != owner) | (nameless != owner_nameless), last


def _edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the range's first hash, its last one and the first document of the latter."""
    first, last = None, None
    for batch, _, last in _runs(batches, None):
        if first is None:
            first = [batch.column(batch.schema.get_field_index(c))[0].as_py() for c in ("part", "hi", "lo")]
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([first[0]], pa.int32()), *[pa.array([v], pa.int64()) for v in [*first[1:], *last[:2]]],
             pa.array([last[2]]), pa.array([last[3]], pa.int64())],
            names=["part", "first_hi", "first_lo", "hi", "lo", "nameless", "doc"])


def _carried(edges: list) -> dict[int, tuple]:
    """By range: hash and first document of the run that reaches into it."""
    carried, before = {}, None
    for e in sorted(edges, key=lambda e: e["part"]):
        goes_on = before is not None and before[:2] == (e["first_hi"], e["first_lo"])
        if goes_on:
            carried[e["part"]] = before
        whole = (e["first_hi"], e["first_lo"]) == (e["hi"], e["lo"])
        if not (goes_on and whole):
            before = (e["hi"], e["lo"], e["nameless"], e["doc"])
    return carried


def _drops(carried: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def known():
            for batch in batches:
                if batch.num_rows:
                    yield batch

        source = known()
        head = next(source, None)
        if head is None:
            return
        part = head.column(head.schema.get_field_index("part"))[0].as_py()

        def chained():
            yield head
            yield from source

        for batch, drop, _ in _runs(chained(), carried.get(part)):
            if drop.any():
                yield batch.filter(pa.array(drop)).select(["row_key", "position"])

    return run


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  least: int = LEAST_CHARS) -> DataFrame:
    """(row_key, position) of the lines that go; see `dedup_lines`. Equal rows of `docs` share a key.

    The sorted ranges are written once, as the bounds of a range partitioning are drawn anew by every
    run. One row per range, not per line, reaches the driver.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"),
                       row_key(F.col(doc_id), F.col(text)).alias("row_key"),
                       F.col(text).alias("text")).mapInArrow(_line_rows(least), LINES)
    order = [*SORTED, "position"]
    ranges = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("part", F.spark_partition_id()))
    edges = ranges.drop("row_key", "position").mapInArrow(_edge, EDGE).collect()
    return ranges.mapInArrow(_drops(_carried(edges)), "row_key binary, position int")


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of a document's id and text."""
    name = F.coalesce(doc_id.cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(name, F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")))


def pack_bits(kept: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(kept).tobytes())


def kept_lines(text: str | None, keep: bytes | None) -> str:
    """A text without the lines whose bit is 0; without a bitmap the whole text."""
    if not text or keep is None:
        return text or ""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, kept in zip(lines, bits) if kept)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns
        counts, dropped, bitmaps, digests = [], [], [], []
        for text, gone in zip(batch.column(n - 2), batch.column(n - 1)):
            lines = (text.as_py() or "").encode().split(b"\n")
            kept = np.ones(len(lines), bool)
            if gone.is_valid:
                kept[gone.values.to_numpy()] = False
            counts.append(len(lines))
            dropped.append(len(lines) - int(kept.sum()))
            bitmaps.append(pack_bits(kept))
            digests.append(hashlib.sha256(b"\n".join(
                [line for line, k in zip(lines, kept) if k] if dropped[-1] else lines)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:n - 2], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()),
             pa.array(bitmaps, pa.binary()), pa.array(digests, pa.string())],
            names=[*batch.schema.names[:n - 2], "n_lines", "n_dropped", "keep", "kept_sha256"])


def dedup_lines(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text",
                least: int = LEAST_CHARS) -> DataFrame:
    """Columns `keep` of `docs` with (n_lines, n_dropped, keep, kept_sha256), one row per row.

    The key of a line is the line without ASCII blanks at its ends, A-Z in lower case. Keys of at
    least `least` code points stay in the least document id that holds them, with all repeats there,
    and go from all others. `keep` has a bit per line, packed and compressed by zlib (`kept_lines`
    applies it), `kept_sha256` is the digest of the lines that stay, joined by line breaks.

    Null and empty texts have one empty line. Rows with one id are one document; rows without an id
    are one document that comes after all others. An empty table gives no rows.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    gone = dropped_lines(docs, doc_id, text, least).groupBy("row_key").agg(
        F.collect_set("position").alias("__gone"))
    told = docs.select(*keep, row_key(F.col(doc_id), F.col(text)).alias("__key"),
                       F.col(text).alias("__text"))
    joined = told.join(gone.withColumnRenamed("row_key", "__key"), "__key", "left").select(
        *[F.col(f"`{c}`") for c in keep], "__text", "__gone")
    schema = StructType([*joined.schema.fields[:len(keep)], *_parse_datatype_string(RESULT).fields])
    return joined.mapInArrow(_judge, schema)


#: `dedup_lines` without its bitmap in the other engine.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
  SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS p FROM d
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(coalesce(doc_id, 9223372036854775807)) AS first FROM k WHERE length(key) >= 10 GROUP BY key
), j AS (
  SELECT k.r, k.doc_id, k.p, k.line, coalesce(k.doc_id, 9223372036854775807) <> f.first AS gone
  FROM k LEFT JOIN f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (gone IS NOT TRUE), '')) AS kept_sha256
FROM j GROUP BY r
"""

by_value(__name__)
