"""License scans: a positional index of licence templates, looked up by rare words.

Templates are indexed as postings (word, template, position). Inverse document frequencies of the
licence words are counted over all documents. A file looks up, for every template, the word of its
mandatory key phrase that has the highest IDF; every occurrence votes for the template at a relative
position. A template at a position is accepted when enough of its IDF weight stands there and all
words of its key phrase do, so no acceptable position is without a vote.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import ANY_CASE_WORD, PLAIN_WORD, ascii_lower

#: The phrases whose places are always counted, with their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Fixed values: (label, words of a notice, mandatory key phrase within it).
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a "
     "copy of the license at", "except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license",
     "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution 4 0 international license",
     "creative commons attribution 4 0"),
    ("gpl-3", "licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2",
     "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3",
     "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
     "permitted", "redistribution and use in source and binary forms"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)
#: Share of a template's IDF weight that has to stand at the position.
LEAST_WEIGHT = 0.6


@dataclass(frozen=True)
class Index:
    """The templates with the IDF of their words; `anchors` are the places of the words looked up."""
    templates: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]
    idf: dict[str, float]
    anchors: tuple[int, ...]


def tokens_of(text: Column) -> Column:
    """Words in lower case by Unicode: a superset of the exact words of ASCII licence phrases."""
    return F.regexp_extract_all(F.lower(text), F.lit(ANY_CASE_WORD), F.lit(0))


def words_array(words) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def build_index(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> Index:
    """Count the documents with each licence word over all of `docs`.

    What reaches the driver is one row: the counts of the template words, a fixed list.
    """
    split = tuple((label, tuple(body.split()), tuple(key.split())) for label, body, key in templates)
    vocabulary = sorted({w for _, body, _ in split for w in body})
    found = docs.select(F.array_distinct(F.array_intersect(
        tokens_of(F.col(text)), words_array(vocabulary))).alias("found"))
    words = found.select(F.explode("found").alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in words.collect()}
    total = docs.count()
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1e-9 for w in vocabulary}
    anchors = tuple(max(range(first, first + len(key)), key=lambda j: idf[body[j]])
                    for _, body, key in split for first in [_key_start(body, key)])
    return Index(split, idf, anchors)


def _key_start(body: tuple[str, ...], key: tuple[str, ...]) -> int:
    """Index of the first word of the key phrase."""
    return next(j for j in range(len(body)) if body[j:j + len(key)] == key)


def _starts(tokens: Column, phrase: tuple[str, ...], anchor: int) -> Column:
    """Positions, from 0, where the words of the phrase stand; `anchor` is its rarest word's index."""
    at = F.filter(F.transform(tokens, lambda w, i: F.when(
        w == phrase[anchor], i - anchor).otherwise(-1)), lambda p: p >= 0)
    return F.filter(at, lambda p: F.slice(tokens, p + 1, F.lit(len(phrase))) == words_array(phrase))


def _constant(value, schema: str) -> Column:
    """A bounded table of the index as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(value)), F.lit(schema))


def _matches(tokens: Column, positions: Column, index: Index) -> Column:
    """(label, score) of every template and start that the positions (w, p) vote for.

    The score is the share of the template's IDF weight that stands there; 0 unless the key phrase is
    complete. Template words beyond the borders of the text do not match.
    """
    postings: dict[str, list] = {}
    table = []
    for t, ((label, body, key), j) in enumerate(zip(index.templates, index.anchors, strict=True)):
        postings.setdefault(body[j], []).append({"t": t, "j": j})
        weights = [index.idf[w] for w in body]
        first = _key_start(body, key)
        table.append({"label": label, "words": [
            {"w": w, "x": x / sum(weights), "k": first <= j < first + len(key)}
            for j, (w, x) in enumerate(zip(body, weights, strict=True))]})
    lists = _constant(postings, "map<string, array<struct<t: int, j: int>>>")
    templates = _constant(
        table, "array<struct<label: string, words: array<struct<w: string, x: double, k: boolean>>>>")
    votes = F.array_distinct(F.flatten(F.transform(positions, lambda x: F.transform(
        F.element_at(lists, x.w), lambda q: F.struct(q.t.alias("t"), (x.p - q.j).alias("start"))))))

    def judged(vote: Column) -> Column:
        template = F.get(templates, vote.t)
        words = F.transform(template.words, lambda x, j: F.struct(
            x.k.alias("k"), x.x.alias("x"),
            F.coalesce(F.get(tokens, vote.start + j) == x.w, F.lit(False)).alias("there")))
        complete = F.forall(words, lambda x: ~x.k | x.there)
        share = F.aggregate(words, F.lit(0.0),
                            lambda a, x: a + F.when(x.there, x.x).otherwise(0.0))
        return F.struct(template.label.alias("label"),
                        F.when(complete, F.least(share, F.lit(1.0))).otherwise(0.0).alias("score"))

    return F.transform(votes, judged)


def scan_licenses(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text",
                  least_weight: float = LEAST_WEIGHT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches).

    One row per row of `docs`, in one projection without a shuffle. `matches` lists (label, score)
    of the accepted templates. A null text is empty; a text without licence words has no places, empty
    labels and score 0. Repeated rows stay.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    looked_up = sorted({body[j] for (_, body, _), j in zip(index.templates, index.anchors, strict=True)})
    anchors = sorted({phrase.split()[_rarest(phrase)] for _, phrase in BASE_PHRASES} | set(looked_up))
    loose = read.withColumn("loose", tokens_of(F.col("t")))
    found = loose.select(
        "doc_id", F.size("loose").cast("bigint").alias("n_words"),
        F.when(F.arrays_overlap("loose", words_array(anchors)), F.col("t")).alias("t"))
    exact = found.withColumn("tokens", F.when(F.col("t").isNotNull(), F.regexp_extract_all(
        ascii_lower(F.col("t")), F.lit(PLAIN_WORD), F.lit(0)))).drop("t")
    places = exact.withColumns({
        f"base{i}": F.coalesce(_starts(F.col("tokens"), tuple(phrase.split()), _rarest(phrase)),
                               F.array().cast("array<int>"))
        for i, (_, phrase) in enumerate(BASE_PHRASES)})
    voted = places.withColumn("positions", F.filter(
        F.transform("tokens", lambda w, i: F.struct(w.alias("w"), i.alias("p"))),
        lambda x: F.array_contains(words_array(looked_up), x.w)))
    scored = voted.withColumn("judged", F.coalesce(
        F.filter(_matches(F.col("tokens"), F.col("positions"), index),
                 lambda m: m.score >= least_weight),
        F.array().cast("array<struct<label: string, score: double>>")))
    everywhere = F.concat(*[F.col(f"base{i}") for i in range(len(BASE_PHRASES))])
    base_labels = F.array_compact(F.array(*[
        F.when(F.size(f"base{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(BASE_PHRASES)]))
    matches = F.col("judged")
    result = scored.select("doc_id", "n_words", everywhere.alias("all"),
                           base_labels.alias("base"), matches.alias("matches"))
    labels = F.array_union("base", F.transform("matches", lambda m: m.label))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m.score)), F.lit(0.0))
    return result.select(
        "doc_id", "n_words", F.size("all").cast("bigint").alias("n_base"),
        F.array_min("all").cast("bigint").alias("first_word"),
        F.array_max("all").cast("bigint").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"), "matches")


def _rarest(phrase: str) -> int:
    """Index of the phrase's most telling word: the first that is not a common English word."""
    common = {"under", "the", "license", "version", "by", "cc", "2"}
    return next(i for i, w in enumerate(phrase.split()) if w not in common)
