"""Secret scans: fixed patterns, and a character convolutional network over other candidates.

Every whole text is read once. The patterns give the base spans. All other long tokens with letters
and digits are candidates; the network reads each with the text around it. It is trained in numpy on
labelled findings, calibrated on held-out ones, and cut at the highest threshold that keeps the
wanted recall there.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tallymark.llm.common import by_value
from tallymark.llm.samples import map_rows

#: The base patterns in the order of their kinds.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
ASSIGN_MARKS = (b"password", b"passwd", b"secret", b"token", b"api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

#: The network's window: characters before the candidate, of a piece of it, and after it.
BEFORE, PIECE, AFTER = 24, 48, 8
WINDOW = BEFORE + PIECE + AFTER
ALPHABET = string.ascii_letters + string.digits + "+/_.=-:\"' \n,;()@#&?%"
CODES = {c: i + 1 for i, c in enumerate(ALPHABET)}
SIDE = len(ALPHABET) + 2  # 0 pads, the last is any other character
WIDTH, FILTERS = 4, 24
RECALL = 0.97


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order; code points, end exclusive."""
    found = []
    lowered = text.encode().lower()
    if any(mark in lowered for mark in ASSIGN_MARKS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of tokens with letters and digits that touch no base span."""
    if not DIGIT.search(text):
        return []
    taken: list[list[int]] = []  # base spans, overlapping ones as one
    for start, _, end in base:
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    spans, i = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        end -= len(m[0]) - len(m[0].rstrip(".=-_/+"))
        token = text[start:end]
        if end - start < 16 or not DIGIT.search(token) or not LETTER.search(token):
            continue
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i == len(taken) or taken[i][0] >= end:
            spans.append((start, end))
    return spans


def windows(text: str, start: int, end: int) -> list[list[int]]:
    """Codes of every piece of a candidate with its surroundings; context has codes of its own."""
    rows, other = [], SIDE - 1
    before = [CODES.get(c, other) + SIDE for c in text[max(0, start - BEFORE):start]]
    after = [CODES.get(c, other) + SIDE for c in text[end:end + AFTER]]
    before, after = [0] * (BEFORE - len(before)) + before, after + [0] * (AFTER - len(after))
    for at in range(start, end, PIECE):
        piece = [CODES.get(c, other) for c in text[at:min(end, at + PIECE)]]
        rows.append(before + piece + [0] * (PIECE - len(piece)) + after)
    return rows


@dataclass
class Network:
    """One convolution over character codes, the maximum over positions, and a logistic output."""
    filters: np.ndarray  # (WIDTH, 2 * SIDE, FILTERS)
    bias: np.ndarray
    output: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = codes.shape[1] - WIDTH + 1
        sums = sum(self.filters[k][codes[:, k:k + steps]] for k in range(WIDTH)) + self.bias
        best = sums.argmax(axis=1)
        return np.maximum(np.take_along_axis(sums, best[:, None, :], 1)[:, 0, :], 0), best

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self.pooled(codes[i:i + 256])[0] @ self.output + self.offset
                 for i in range(0, len(codes), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.shift, -60, 60)))


def labelled_findings(count: int = 3000, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): findings in made-up surroundings, by rules and a fixed seed.

    Secrets are random keys of common shapes; the others are look-alikes: versions, addresses, paths,
    dates, identifiers, checksummed names and words with numbers.
    """
    rng = np.random.default_rng(seed)
    syllables = "the re in on er ti ou an th es le de qu ma zu ge ver sch cion ado ment eau".split()

    def chars(alphabet: str, n: int) -> str:
        return "".join(rng.choice(list(alphabet), n))

    def word() -> str:
        return "".join(rng.choice(syllables, rng.integers(1, 5)))

    def prose(n: int) -> str:
        return " ".join(word() for _ in range(n))

    mixed, lower = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    secret = (
        lambda: chars(mixed, rng.integers(24, 60)), lambda: "ghp_" + chars(mixed, 36),
        lambda: "sk_live_" + chars(mixed, 24), lambda: "sk-" + chars(mixed, 48),
        lambda: "xoxb-" + chars(string.digits, 12) + "-" + chars(mixed, 24),
        lambda: chars(mixed + "+/", 40), lambda: "eyJ" + chars(mixed, 30) + "." + chars(mixed + "_-", 43),
        lambda: chars(lower, rng.integers(20, 48)), lambda: "AIza" + chars(mixed + "_-", 35),
        lambda: chars(string.hexdigits.upper(), 32), lambda: "glpat-" + chars(mixed, 20),
    )
    plain = (
        lambda: f"{word()}.example.com/{word()}/{rng.integers(1e5)}",
        lambda: f"v{rng.integers(9)}.{rng.integers(30)}.{rng.integers(99)}-{word()}.{rng.integers(999)}",
        lambda: f"20{rng.integers(10, 30)}-0{rng.integers(1, 9)}-1{rng.integers(9)}T1{rng.integers(9)}.{rng.integers(10, 60)}.00Z",
        lambda: "-".join(chars("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        lambda: f"/usr/{word()}/{word()}{rng.integers(99)}/{word()}.txt",
        lambda: word() + word() + word() + str(rng.integers(1e4)),
        lambda: f"{word()}_{word()}_{word()}_{rng.integers(1e3)}",
        lambda: f"{word()}.{word()}{rng.integers(1e3)}.example.org",
        lambda: "=" * rng.integers(8, 20) + word() + str(rng.integers(99)),
        lambda: str(rng.integers(1, 255)) + ".192.168.10." + word(),
        lambda: (word()[:4] + str(rng.integers(9))) * int(rng.integers(5, 9)),
    )
    leads = ("key: ", "Bearer ", "credential=", "pass ", "auth ", "private_key = \"", "", " ", " ", " ")
    rows = []
    for i in range(count):
        label = int(i % 2 == 0)
        made = (secret if label else plain)[rng.integers(len(secret if label else plain))]()
        made = made.ljust(16, "0") if label else made + "".join(word() for _ in range(4)) * (len(made) < 16)
        lead = str(rng.choice(leads)) if label else str(rng.choice(["", " ", "see ", "at "]))
        head = prose(rng.integers(0, 6)) + " " + lead
        rows.append((head + made + " " + prose(rng.integers(0, 4)), len(head), len(head) + len(made), label))
    return rows


def fit(findings: list[tuple[str, int, int, int]], recall: float = RECALL, epochs: int = 12,
        seed: int = 1) -> Network:
    """Train on four of five findings; calibrate and set the threshold on the fifth."""
    rng = np.random.default_rng(seed)
    pieces = [(w, label) for text, a, b, label in findings for w in windows(text, a, b)[:1]]
    codes = np.array([w for w, _ in pieces], dtype=np.int64).reshape(len(pieces), WINDOW)
    y = np.array([label for _, label in pieces], dtype=float)
    held = np.arange(len(y)) % 10 > 7
    net = Network(rng.normal(0, 0.15, (WIDTH, 2 * SIDE, FILTERS)), np.zeros(FILTERS),
                  rng.normal(0, 0.3, FILTERS), 0.0)
    learn, rate = np.flatnonzero(~held), 0.05
    for epoch in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), 32):
            rows = learn[at:at + 32]
            pooled, best = net.pooled(codes[rows])
            error = 1 / (1 + np.exp(-(pooled @ net.output + net.offset))) - y[rows]
            back = error[:, None] * net.output * (pooled > 0)
            net.output -= rate * (pooled.T @ error) / len(rows) * 4
            net.offset -= rate * error.mean() * 4
            net.bias -= rate * back.mean(axis=0) * 4
            for k in range(WIDTH):
                touched = codes[rows][np.arange(len(rows))[:, None], best + k]
                np.add.at(net.filters[k], (touched, np.arange(FILTERS)[None, :]),
                          -rate * back / len(rows) * 32)
        rate *= 0.85
    raw, truth = net.logits(codes[held]), y[held]
    for _ in range(500):  # calibration: a logistic fit of the held-out logits
        p = 1 / (1 + np.exp(-(net.slope * raw + net.shift)))
        net.slope -= 0.05 * float(((p - truth) * raw).mean())
        net.shift -= 0.05 * float((p - truth).mean())
    secrets = np.sort(net.probability(codes[held])[truth > 0])
    if len(secrets):
        net.threshold = float(secrets[int((1 - recall) * len(secrets))])
    return net


def find_secrets(docs: DataFrame, net: Network, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` with n_assign, n_access, n_hex, base_sha256, spans, n_candidates, top_score.

    `spans` lists all spans as kind:start:end by start, then kind; `base_sha256` is the digest of the
    base ones in this form. A null text is empty: no spans, the digest of an empty string. Repeated
    rows stay and agree. Texts are read whole, with one batch of them in memory.
    """
    def make():
        def judge(texts):
            bases = [base_spans(t or "") for t in texts]
            at = [[(i, s) for s in candidates(t or "", b)]
                  for i, (t, b) in enumerate(zip(texts, bases, strict=True))]
            flat = [x for own in at for x in own]
            scores = _scores(net, texts, flat)
            extra = [[] for _ in texts]
            top = [0.0] * len(texts)
            for (i, (start, end)), score in zip(flat, scores, strict=True):
                top[i] = max(top[i], score)
                if score >= net.threshold:
                    extra[i].append((start, 3, end))
            joined = [spans_text(b) for b in bases]
            counts = {f"n_{KINDS[k]}": [sum(s[1] == k for s in b) for b in bases] for k in range(3)}
            return counts | {
                "base_sha256": [hashlib.sha256(j.encode()).hexdigest() for j in joined],
                "spans": [spans_text(sorted(b + e)) for b, e in zip(bases, extra, strict=True)],
                "n_candidates": [len(x) for x in at], "top_score": top}
        return judge

    return map_rows(docs, keep, text, "n_assign bigint, n_access bigint, n_hex bigint, "
                    "base_sha256 string, spans string, n_candidates bigint, top_score double", make)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scores(net: Network, texts: list, flat: list) -> list[float]:
    """The highest score among the pieces of each candidate, a thousand candidates at a time."""
    result: list[float] = []
    for at in range(0, len(flat), 1000):
        rows, owner = [], []
        for j, (i, (start, end)) in enumerate(flat[at:at + 1000]):
            made = windows(texts[i], start, end)
            rows += made
            owner += [j] * len(made)
        p = net.probability(np.array(rows, dtype=np.int64))
        best = np.zeros(len(flat[at:at + 1000]))
        np.maximum.at(best, np.array(owner), p)
        result += best.tolist()
    return result


by_value(__name__)
