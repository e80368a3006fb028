"""Benchmark decontamination with a distributed positional inverted index.

The training texts become index segments: each holds some documents and, for every test term, the
sorted positions of its occurrences. Segments are written once to the shared folder. A search walks
the windows of the benchmark: it takes the list of the rarest term, shifted by the term's place in
the window, and intersects it with the shifted lists of the next rarer terms. What is left are exact
phrases; terms near each other are found by distance in the same lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import by_value, plain_words
from tallymark.session import shared_path

WINDOW = 10
#: Words of one segment, a document more at most; its positions take four bytes each.
SEGMENT_WORDS = 1 << 19
#: Words of the benchmark that are searched at a time; beyond it the items go in several rounds.
ROUND_WORDS = 2_000_000
#: Between documents of a segment, so that no window spans two.
GAP = 32

INDEX_SCHEMA = ("doc_ids array<bigint>, digests array<bigint>, n_words array<int>, "
                "terms array<int>, counts array<int>, positions binary")
MATCH_SCHEMA = ("doc_id bigint, digest bigint, n_words bigint, "
                "spans array<struct<start: int, end: int>>, items array<bigint>, near array<bigint>")


@dataclass
class Plan:
    """Windows of some items over numbered terms.

    `by_size[k]` has the windows of k words, a row each, and `owners[k]` the items of each window.
    """
    terms: dict[bytes, int]
    by_size: dict[int, np.ndarray]
    owners: dict[int, list[list[int]]]


def plan_windows(items: list[tuple[int, str | None]], window: int = WINDOW) -> Plan:
    """Windows of `window` words of each item, or the whole item where it is shorter.

    Windows of items without an id have no owner and are searched like all others.
    """
    terms: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for item_id, text in items:
        words = [terms.setdefault(w, len(terms)) for w in plain_words(text)]
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            owners = found.setdefault(size, {}).setdefault(tuple(words[at:at + size]), set())
            if item_id is not None:
                owners.add(item_id)
    return Plan(terms, {k: np.array(list(w), dtype=np.int64) for k, w in found.items()},
                {k: [sorted(o) for o in w.values()] for k, w in found.items()})


def index_segments(docs: DataFrame, terms: dict[bytes, int], doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Index segments of `docs` for the given terms: postings by term, positions by occurrence.

    Position p of a segment is word p - start of the document whose words start there. A null text
    has no words. Every row of `docs` is in one segment, repeated ones too.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                         F.xxhash64(F.col(text)).alias("digest"))

    def segment(ids, digests, sizes, words) -> pa.RecordBatch:
        starts = np.cumsum([0, *[n + GAP for n in sizes[:-1]]])
        number = np.concatenate(words) if words else np.zeros(0, np.int32)
        place = np.concatenate([np.arange(s, s + n, dtype=np.int32)
                                for s, n in zip(starts, sizes, strict=True)])
        known = number >= 0
        number, place = number[known], place[known]
        order = np.argsort(number, kind="stable")
        counts = np.bincount(number, minlength=len(terms)) if len(number) else np.zeros(0, int)
        present = np.flatnonzero(counts)
        values = [ids, digests, sizes, present.astype(np.int32), counts[present].astype(np.int32),
                  place[order].tobytes()]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()),
                 pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        names = ["doc_ids", "digests", "n_words", "terms", "counts", "positions"]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, sizes, words, total = [], [], [], [], 0
        number_of = terms.get
        for batch in batches:
            for one_id, one_text, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tokens = plain_words(one_text)
                ids.append(one_id)
                digests.append(digest)
                sizes.append(len(tokens))
                words.append(np.fromiter((number_of(w, -1) for w in tokens), np.int32, len(tokens)))
                total += len(tokens) + GAP
                if total >= SEGMENT_WORDS:
                    yield segment(ids, digests, sizes, words)
                    ids, digests, sizes, words, total = [], [], [], [], 0
        if ids:
            yield segment(ids, digests, sizes, words)

    return source.mapInArrow(run, INDEX_SCHEMA)


def write_index(docs: DataFrame, terms: dict[bytes, int], path: str, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Store the segments below `path` and read them back; whoever names the path clears it."""
    index_segments(docs, terms, doc_id, text).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def term_counts(index: DataFrame, terms: int) -> np.ndarray:
    """Occurrences of each term in the whole index; a number per term of the plan."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    totals = np.zeros(terms, dtype=np.int64)
    for row in pairs.groupBy("x.terms").agg(F.sum("x.counts").alias("n")).collect():
        totals[row["terms"]] = row["n"]
    return totals


class Postings:
    """Lists of one segment: `of(t)` are the sorted positions of term t."""

    def __init__(self, terms, counts, positions: bytes, size: int):
        self.places = np.frombuffer(positions, np.int32)
        self.first = np.zeros(size + 1, dtype=np.int64)
        self.first[np.asarray(terms, dtype=np.int64) + 1] = counts
        self.present = self.first[1:] > 0
        self.first = np.cumsum(self.first)

    def of(self, term: int) -> np.ndarray:
        return self.places[self.first[term]:self.first[term + 1]]

    def phrase(self, terms: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Starts of the phrase, intersecting from the rarest term on."""
        starts = self.of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            places, wanted = self.of(terms[k]), starts + k
            at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
            starts = starts[places[at] == wanted]
        return starts

    def near(self, terms: np.ndarray, order: np.ndarray, slack: int) -> np.ndarray:
        """Places of the rarest term with all others within the window's length and `slack`."""
        places, reach = self.of(terms[order[0]]), len(terms) - 1 + slack
        for k in order[1:]:
            if not len(places):
                break
            other = self.of(terms[k])
            after = np.searchsorted(other, places - reach)
            places = places[(after < len(other))
                            & (other[np.minimum(after, len(other) - 1)] <= places + reach)]
        return places


def search(index: DataFrame, plan: Plan, totals: np.ndarray, slack: int | None = None) -> DataFrame:
    """(doc_id, digest, n_words, spans, items, near): a row per indexed document.

    `spans` are the merged runs of words inside an occurring window, by word from 0, end exclusive;
    `items` the items with an occurring window. With `slack` also `near`, the items of which all
    terms of a window stand close together in any order.
    """
    size = len(plan.terms)
    orders = {k: np.argsort(totals[w], axis=1, kind="stable") for k, w in plan.by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _search_segment(batch.slice(row, 1), plan, orders, size, slack)

    return index.select("doc_ids", "digests", "n_words", "terms", "counts", "positions").mapInArrow(
        run, MATCH_SCHEMA)


def _search_segment(row: pa.RecordBatch, plan: Plan, orders: dict[int, np.ndarray], size: int,
                    slack: int | None) -> pa.RecordBatch:
    ids, digests, sizes, terms, counts, positions = (c[0].as_py() for c in row.columns)
    lists = Postings(terms, counts, positions, size)
    lengths = np.array(sizes, dtype=np.int64)
    starts = np.cumsum(np.concatenate([[0], lengths[:-1] + GAP])) if len(sizes) else np.zeros(0, int)
    edges = np.zeros(int(starts[-1] + lengths[-1] + GAP + 1), dtype=np.int32)
    items: dict[int, set[int]] = {}
    near: dict[int, set[int]] = {}

    def note(found: dict[int, set[int]], places: np.ndarray, owners: list[int]) -> None:
        for doc in np.unique(np.searchsorted(starts, places, side="right") - 1).tolist():
            found.setdefault(doc, set()).update(owners)

    for k, windows in plan.by_size.items():
        for w in np.flatnonzero(lists.present[windows].all(axis=1)).tolist():
            hits = lists.phrase(windows[w], orders[k][w])
            if len(hits):
                np.add.at(edges, hits, 1)
                np.add.at(edges, hits + k, -1)
                note(items, hits, plan.owners[k][w])
            if slack is not None:
                note(near, lists.near(windows[w], orders[k][w], slack), plan.owners[k][w])
    covered = np.concatenate([[0], (np.cumsum(edges) > 0).astype(np.int8)])
    turns = np.diff(covered)
    opens, closes = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    spans: dict[int, list[dict[str, int]]] = {}
    for a, b, doc in zip(opens.tolist(), closes.tolist(),
                         (np.searchsorted(starts, opens, side="right") - 1).tolist(), strict=True):
        spans.setdefault(doc, []).append({"start": a - int(starts[doc]), "end": b - int(starts[doc])})
    every = range(len(ids))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(sizes, pa.int64()),
         pa.array([spans.get(i, []) for i in every], span_type),
         pa.array([sorted(items.get(i, ())) for i in every], pa.list_(pa.int64())),
         pa.array([sorted(near.get(i, ())) for i in every], pa.list_(pa.int64()))],
        names=["doc_id", "digest", "n_words", "spans", "items", "near"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  slack: int | None = None, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, digest, n_words, spans, items, near), one row per row of `docs`.

    The benchmark is counted first and searched in rounds of at most about `ROUND_WORDS` words, so
    what a task and the driver hold of it is bounded. `digest` is `xxhash64` of the text: with the id
    it tells rows apart where ids repeat. Items without an id or words have no windows; repeated item
    ids count as one item. Null and empty texts have no words and no matches.
    """
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"),
                             F.col(item_text).alias("text"))
    bytes_of = F.coalesce(F.octet_length("text"), F.lit(0))
    words = (items.agg(F.sum(bytes_of)).first()[0] or 0) / 5
    rounds = int(words // ROUND_WORDS) + 1
    found = [
        _round(docs, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r),
               window, slack, doc_id, text)
        for r in range(rounds)]
    result = found[0]
    for more in found[1:]:
        key = [result["doc_id"].eqNullSafe(F.col("__id")), result["digest"] == F.col("__digest")]
        other = more.dropDuplicates(["doc_id", "digest"]).select(
            F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"),
            F.col("spans").alias("__spans"), F.col("items").alias("__items"),
            F.col("near").alias("__near"))
        result = result.join(other, key).select(
            "doc_id", "digest", "n_words", _merged(F.concat("spans", "__spans")).alias("spans"),
            F.sort_array(F.array_union("items", "__items")).alias("items"),
            F.sort_array(F.array_union("near", "__near")).alias("near"))
    return result


def _round(docs: DataFrame, items: DataFrame, window: int, slack: int | None,
           doc_id: str, text: str) -> DataFrame:
    plan = plan_windows([(r["item_id"], r["text"]) for r in items.collect()], window)
    path = shared_path(docs.sparkSession, "positional-index")
    index = write_index(docs, plan.terms, path, doc_id, text)
    return search(index, plan, term_counts(index, len(plan.terms)), slack)


def _merged(spans: Column) -> Column:
    """Overlapping and touching spans as one."""
    empty = F.array().cast("array<struct<start: int, end: int>>")
    return F.aggregate(F.array_sort(spans), empty, lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1).end >= s.start),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(
            F.element_at(a, -1).start.alias("start"),
            F.greatest(F.element_at(a, -1).end, s.end).alias("end"))))
    ).otherwise(F.array_append(a, s)))


def digest_columns(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of `decontaminate` rows."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s.end - s.start))
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


#: `decontaminate` and its digest in the other engine.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p + 1:p + k], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM sized)
), shown AS (
  SELECT r, k, p, array_to_string(w[p + 1:p + k], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS p
        FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
  SELECT r, p, k, item_id FROM shown JOIN windows USING (k, s)
), counted AS (
  SELECT r, count(DISTINCT q) AS n_hit
  FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r
), owners AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (r) LEFT JOIN owners USING (r)
"""

by_value(__name__)
