"""Toxicity: Levenshtein automata over a lexicon trie, and scores of the words around each hit.

The lexicon of words and word stems is learned from labelled documents: those that labelled texts
use in many different surroundings and clean texts hardly use. All terms form one trie, and the
Levenshtein automata of the terms run on it at once: a state is a set of (trie node, errors), made
once and kept. Hits are weighed by where they stand: in quotation marks or not, alone or among other
hits. A logistic model of these figures gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import by_value, plain_words
from tallymark.llm.samples import fold_of, labelled_sample, map_rows
from tallymark.session import cut

#: Most labelled documents that are learned from, and most terms of the lexicon.
SAMPLE_ROWS, MOST_TERMS = 20_000, 4_000
STEM_SIZES = (4, 5, 6, 7)
#: Words on each side of a hit that are its context.
CONTEXT = 8
LEAST_SHARE = 0.8
FUZZY_SIZE = 5
WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile(r"[\"“”„«»‹›]")
FEATURES = ("exact", "fuzzy", "quoted", "density", "cluster", "any_exact", "open_share")


@dataclass
class Trie:
    """Lexicon trie with the joint automaton of its terms, up to one error in a word.

    `ends` maps a node to the term that ends there; a term that is a stem accepts any word that
    begins with it. Stems match without errors, words of `FUZZY_SIZE` letters or more with one.
    """
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, int] = field(default_factory=dict)
    stems: set[int] = field(default_factory=set)
    fuzzy: set[int] = field(default_factory=set)
    states: dict[frozenset, int] = field(default_factory=dict)
    moves: list[dict[str, int]] = field(default_factory=list)
    sets: list[frozenset] = field(default_factory=list)
    accepts: list[tuple[int, int] | None] = field(default_factory=list)
    early: list[int | None] = field(default_factory=list)

    @classmethod
    def of(cls, terms: Iterable[tuple[str, bool]]) -> Trie:
        trie = cls()
        for number, (term, stem) in enumerate(terms):
            node = 0
            for c in term:
                node = trie.children[node].setdefault(c, len(trie.children))
                if node == len(trie.children):
                    trie.children.append({})
            trie.ends.setdefault(node, number)
            if stem:
                trie.stems.add(node)
            elif len(term) >= FUZZY_SIZE:
                trie.fuzzy.add(number)
        trie._state(trie._closed({(0, 0)}))
        return trie

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With what a letter left out reaches; of a node only its fewest errors."""
        grown = dict()
        for node, errors in pairs:
            grown[node] = min(errors, grown.get(node, 2))
        for node, errors in list(grown.items()):
            if errors == 0:
                for child in self.children[node].values():
                    grown[child] = min(1, grown.get(child, 2))
        return frozenset(grown.items())

    def _state(self, pairs: frozenset) -> int:
        number = self.states.get(pairs)
        if number is None:
            number = self.states[pairs] = len(self.moves)
            self.moves.append({})
            self.sets.append(pairs)
            found = [(e, self.ends[n]) for n, e in pairs
                     if n in self.ends and (e == 0 or self.ends[n] in self.fuzzy)]
            self.accepts.append(min(found) if found else None)
            self.early.append(min((self.ends[n] for n, e in pairs if e == 0 and n in self.stems),
                                  default=None))
        return number

    def _move(self, state: int, c: str) -> int:
        """The state after `c`: the letter itself, another one in its place, or one too many."""
        following: set[tuple[int, int]] = set()
        for node, errors in self.sets[state]:
            for letter, child in self.children[node].items():
                if letter == c:
                    following.add((child, errors))
                elif errors == 0:
                    following.add((child, 1))
            if errors == 0:
                following.add((node, 1))
        number = self._state(self._closed(following)) if following else -1
        self.moves[state][c] = number
        return number

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, term) of the best term for the whole word, or of a stem it begins with."""
        state, stem = 0, None
        for c in word:
            following = self.moves[state].get(c)
            state = self._move(state, c) if following is None else following
            if state < 0:
                break
            if self.early[state] is not None:
                stem = (0, self.early[state])
        found = self.accepts[state] if state >= 0 else None
        return min((x for x in (stem, found) if x is not None), default=None)


class Matcher:
    """Terms of texts; words that match nothing are remembered up to a bound."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms, self.trie, self.clean = terms, Trie.of(terms), set()

    def hits(self, words: set[bytes]) -> dict[str, tuple[int, int]]:
        found = {}
        for raw in words - self.clean:
            word = raw.decode()
            # Beyond ASCII, quotation marks and dashes are not yet split off.
            matched = {part: self.trie.match(part)
                       for part in ((word,) if raw.isascii() else WORD.findall(word))}
            matched = {part: hit for part, hit in matched.items() if hit is not None}
            found |= matched
            if not matched:
                if len(self.clean) >= 500_000:
                    self.clean.clear()
                self.clean.add(raw)
        if len(self.trie.moves) > 200_000:  # states of rare letters
            self.trie = Trie.of(self.terms)
        return found


def describe(text: str | None, matcher: Matcher, strength: list[float]) -> list[float]:
    """The features of one whole text; all 0 without a hit."""
    words = plain_words(text)
    hits = matcher.hits(set(words)) if words else {}
    if not hits:
        return [0.0] * len(FEATURES)
    exact = fuzzy = quoted = cluster = 0.0
    places: list[int] = []
    open_hits = 0
    # The letters of A-Z only, so that offsets stay those of the text.
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    marks = [m.start() for m in QUOTES.finditer(lowered)]
    line_start, seen = 0, 0
    for number, m in enumerate(WORD.finditer(lowered)):
        hit = hits.get(m[0])
        if hit is None:
            continue
        line_start = lowered.rfind("\n", line_start, m.start()) + 1 or line_start
        while seen < len(marks) and marks[seen] < m.start():
            seen += 1
        first = np.searchsorted(marks, line_start) if marks else 0
        closes = seen < len(marks) and "\n" not in lowered[m.end():marks[seen]]
        in_quotes = (seen - first) % 2 == 1 and closes
        near = sum(1 for p in places[-8:] if number - p <= CONTEXT)
        places.append(number)
        weight = strength[hit[1]]
        cluster = max(cluster, near + 1)
        if in_quotes:
            quoted += weight
        elif hit[0]:
            fuzzy += weight
        else:
            exact += weight
            open_hits += 1
    total = max(1, len(places))
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted),
            100.0 * len(places) / max(20, len(words)), math.log1p(cluster),
            float(exact > 0), open_hits / total]


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    strength: list[float]
    weights: np.ndarray
    scale: np.ndarray


def _grams(text: str | None, wanted: set[str] | None) -> dict[str, list[int]]:
    """Words and stems (with a mark) of a text with a checksum of the words beside them."""
    words = plain_words(text)
    found: dict[str, set[int]] = defaultdict(set)
    for i, raw in enumerate(words):
        w = raw.decode()
        if len(w) < 4 or w.isdigit():
            continue
        around = zlib.crc32(b" ".join((words[i - 1] if i else b"", *words[i + 1:i + 2])))
        for gram in (w, *[f"{w[:n]}*" for n in STEM_SIZES if n < len(w)]):
            if wanted is None or gram in wanted:
                found[gram].add(around)
    return found


def _contexts(sample: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(gram, n): different surroundings of each gram in `sample`, so that copies count once."""
    def make():
        def judge(texts):
            made = [_grams(t, wanted) for t in texts]
            return {"grams": [[{"gram": g, "around": a} for g, s in m.items() for a in s] for m in made]}
        return judge

    exploded = map_rows(sample.select("text"), [], "text",
                        "grams array<struct<gram: string, around: bigint>>", make)
    return exploded.select(F.explode("grams").alias("g")).select("g.gram", "g.around").distinct() \
        .groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """(term, is a stem, strength) from (text, label): at most `MOST_TERMS` terms.

    A term's surroundings have to be in toxic texts far more than chance allows for as many grams as
    are tried. A term that begins with a chosen stem is left out.
    """
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n")).collect()}
    share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    toxic = _contexts(sample.where("label = 1"), None)
    often = toxic.where("n >= 4").orderBy(F.desc("n"), "gram").limit(50_000).collect()
    counts = {r["gram"]: r["n"] for r in often}
    if not counts:
        return []
    clean = _contexts(sample.where("label = 0"), set(counts))
    other = {r["gram"]: r["n"] for r in clean.collect()}
    tried = math.log(len(counts) * 20)
    good = []
    for gram, n in counts.items():
        m = other.get(gram, 0)
        p = n / (n + m)
        evidence = n * math.log(p / share) + (m * math.log((1 - p) / (1 - share)) if m else 0)
        if p >= LEAST_SHARE and evidence > tried:
            good.append((gram, n, math.log((n + 0.5) / (m + 0.5) * (1 - share) / share)))
    chosen: list[tuple[str, bool, float]] = []
    stems: set[str] = set()
    for gram, _, strength in sorted(good, key=lambda x: (len(x[0].rstrip("*")), x[0])):
        body = gram.rstrip("*")
        if not any(body[:n] in stems for n in STEM_SIZES if n <= len(body)):
            # A stem that stands for hardly more than one word is that word.
            longest = max((counts.get(g, 0) for g in _extensions(body, counts)), default=0)
            if gram.endswith("*") and longest > 0.9 * counts[gram]:
                continue
            chosen.append((body, gram.endswith("*"), max(0.1, strength)))
            if gram.endswith("*"):
                stems.add(body)
    return sorted(chosen, key=lambda x: (-x[2], x[0]))[:MOST_TERMS]


def _extensions(body: str, counts: dict[str, int]) -> list[str]:
    return [g for g in counts if not g.endswith("*") and len(g) > len(body) and g.startswith(body)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS,
        held_out: int = 0) -> Model:
    """Lexicon and weights from at most `rows` labelled documents outside the fold `held_out`.

    Counts of grams and the figures of the sample reach the driver, no texts.
    """
    sample = cut(labelled_sample(docs, labels, label, rows, fold_of(F.col("__id")) != held_out)
                 .repartition(32, "doc_id"))
    lexicon = learn_lexicon(sample)
    terms, strength = [(t, s) for t, s, _ in lexicon], [x for _, _, x in lexicon]

    def make():
        matcher = Matcher(terms)

        def judge(texts):
            return {"features": [describe(t, matcher, strength) for t in texts]}
        return judge

    got = map_rows(sample, ["doc_id", "label"], "text", "features array<double>", make).collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"]))
    x = np.array([r["features"] for r in got], dtype=float).reshape(len(got), len(FEATURES))
    y = np.array([r["label"] > 0 for r in got], dtype=float)
    scale = np.maximum(x.max(axis=0, initial=0.0), 1e-9)
    return Model(terms, strength, logistic(x / scale, y), scale)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 40) -> np.ndarray:
    """Weights with the intercept last, by Newton steps with a ridge penalty."""
    full = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(full.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (y - p) - ridge * w
        curve = (full * (p * (1 - p))[:, None]).T @ full + np.diag(ridge)
        w += np.clip(np.linalg.solve(curve, slope), -5, 5)
    return w


def score_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` with `score` (0 to 1) and `predicted`, for every whole text.

    Null and empty texts have no hits and get the score of such texts. Equal texts get equal scores;
    no other column takes part.
    """
    def make():
        matcher = Matcher(model.terms)

        def judge(texts):
            x = np.array([describe(t, matcher, model.strength) for t in texts]).reshape(
                len(texts), len(FEATURES))
            full = np.hstack([np.minimum(x / model.scale, 3.0), np.ones((len(x), 1))])
            score = 1 / (1 + np.exp(-np.clip(full @ model.weights, -30, 30)))
            return {"score": score.tolist(), "predicted": (score >= 0.5).astype(int).tolist()}
        return judge

    return map_rows(docs, keep, text, "score double, predicted int", make)


def held_out_column(doc_id: Column, fold: int = 0) -> Column:
    return F.coalesce(fold_of(doc_id) == fold, F.lit(False))


by_value(__name__)
