import hashlib
import random
import zlib

import pytest

from tallymark.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    paths = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    made = {}
    for c, path in paths.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = paths.get(base, [])[:h] + path[h:]
    return made


def brute(paths):
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    children = {k: sum(1 for x in nodes if len(x) == len(k) + 1 and x[:-1] == k) for k in nodes}
    out = set()
    for k, members in nodes.items():
        under = [x for x in nodes if x[:len(k)] == k]
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(k))
        out.add((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k],
                 sum(children[x] == 0 for x in under),
                 sum((len(nodes[x]) - 1) * (len(x[-1][1]) if x else 0) for x in under),
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-205, -190), *range(0, 60), *range(195, 260)]:
        kind = rng.random()
        for t in range(rng.randrange(1, 9)):
            text = "the same" if kind < 0.3 else rng.choice(["a", "bé", "", None, "c" * 50])
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "user", None]) if kind > 0.3 else "user", text))
    rows += [(500 + c, t, "user", f"hot {t}") for c in range(100) for t in range(4)]
    rows += [(700 + k, t, "assistant", f"long {t}") for k in (0, 1, 2) for t in range(60)]
    return rows + [(None, 1, "user", "no conversation"), (None, None, None, None), (7, 99, "user", "é" * 30_000)]


@pytest.mark.parametrize("kind", ["plain", "saturated", "blocks"])
def test_against_brute_force(spark, monkeypatch, kind):
    if kind == "saturated":  # most estimates are above one, so singletons are grouped as well
        for name in ("LEAST_WIDTH", "MOST_WIDTH", "PIECE"):
            monkeypatch.setattr(prefix_trie, name, 256)
    if kind == "blocks":
        monkeypatch.setattr(prefix_trie, "BLOCK", 2)
        monkeypatch.setattr(prefix_trie, "ID_SPAN", 3)
    rows = conversations(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).selectExpr("*", "role AS key", "turn AS depth", "1 AS reach")
    trie = prefix_trie.prefix_trie(prefix_trie.with_shared_openings(prefix_trie.order_turns(df)))
    got = [tuple(r) for r in trie.collect()]
    want = brute(rebuilt(rows))
    assert set(got) == want and len(got) == len(want)


def test_turnless_and_empty(spark):
    # An id whose own turns are all replaced by those of a conversation that is not there.
    c = next(i for i in range(101, 199) if zlib.crc32(str(i).encode()) % 6 == 5)
    rows = [(c, 0, "user", "gone"), (c, 1, "assistant", "gone")]
    df = spark.createDataFrame(rows, SCHEMA)
    trie = prefix_trie.prefix_trie(prefix_trie.with_shared_openings(prefix_trie.order_turns(df)))
    assert {tuple(r) for r in trie.collect()} == brute({c: []})
    empty = prefix_trie.with_shared_openings(prefix_trie.order_turns(df.limit(0)))
    assert prefix_trie.prefix_trie(empty).count() == 0


def test_estimates_never_fall_short(spark):
    rng = random.Random(4)
    keys = [rng.randbytes(16) for _ in range(3000)]
    rows = [(1, bytearray(k)) for k in keys] + [(2, bytearray(k)) for k in keys[:500]]
    df = spark.createDataFrame(rows, "depth bigint, key binary").repartition(7)
    bits = prefix_trie.seen_twice(df, 1 << 16)
    shared = {bytes(r["key"]) for r in prefix_trie.screen(df, bits).where("shared").collect()}
    assert set(keys[:500]) <= shared
    assert len(shared) < 520
