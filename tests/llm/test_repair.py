import hashlib
import random
import re
import zlib
from itertools import count

import pytest

from tallymark.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        shown = [" " if v is None else v for v in (c, t, role, text)]
        fate = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if fate == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        out += [(c, t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        found.append("blank" if not end else "duplicate" if (role, text) in seen
                     else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """(cost, audit) by a table over rows from the last one, strings compared whole."""
    ends = {"": (0, ""), "s": (6, "II"), "u": (3, "I"), "a": (0, "")}
    table = ends
    for (role, _), fault in zip(reversed(rows), reversed(found)):
        new = {}
        for q in NEXT:
            c, a = table[q]
            options = [(c + 4, "D" + a)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[0] in NEXT[q]:
                    c, a = table[role[0]]
                    options.append((c + more, "K" + a))
                c, a = table[NEXT[q][-1]]
                options.append((c + 3 + more, "R" + a))
            new[q] = min(options)
        for _ in range(4):  # inserts before the row
            new = {q: min(new[q], (new[NEXT[q][-1]][0] + 3, "I" + new[NEXT[q][-1]][1])) for q in new}
        table = new
    return table[""]


def applied(rows, audit):
    out, state, own = [], "", iter(rows)
    for letter in audit:
        if letter == "I":
            state = NEXT[state][-1]
            out.append(f"{NAMES[state]}:")
            continue
        role, text = next(own)
        if letter == "K":
            state = role[0]
            out.append(f"{role}:{text}")
        if letter == "R":
            state = NEXT[state][-1]
            out.append(f"{NAMES[state]}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(o[0] for o in out))
    return "\n".join(out)


def brute(rows, original):
    convs = {r[0]: [] for r in original}
    for r in rows:
        convs[r[0]].append(r)
    out = set()
    for c, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in own if r[1] is not None}
        said = [r[2:] for r in own]
        found = faults(said)
        initials = "".join(r[2][:1] or "?" for r in own)
        cost, audit = cheapest(said, found)
        out.add((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                 *[found.count(k) for k in ("blank", "duplicate", "truncated")],
                 sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(own) - 1)),
                 cost, audit, hashlib.sha256(applied(said, audit).encode()).hexdigest()))
    return out


def conversations(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        turn = count(rng.randrange(3))
        for _ in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "a"])
            text = rng.choice(["Hello.", "Yes!", "so then", "", " \t\n", None, f"Say {rng.randrange(99)}?", "é. ", "\xa0"])
            rows.append((c, next(turn) + rng.choice([0, 0, 0, 2]) if rng.random() < 0.9 else None, role, text))
    return rows


@pytest.mark.parametrize("block, longest, convs", [(1024, 9, 150), (3, 30, 40), (1, 12, 40)])
def test_against_a_table_of_strings(spark, monkeypatch, block, longest, convs):
    monkeypatch.setattr(repair, "BLOCK", block)
    repair.block_ways.cache_clear()
    rows = conversations(block, convs, longest) + [(None, None, None, None), (None, 1, "user", "Why?"), (None, None, "user", "x")]
    rows += [(-4, i, "user" if i % 2 == 0 else "assistant", f"{'long ' * 4000}{i}.") for i in range(7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    extra = df.selectExpr("*", "1 AS pos", "text AS block", "role AS audit")
    got = repair.with_all_conversations(repair.repair_conversations(repair.damage(extra)), df)
    want = brute(damaged(rows), rows)
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


def test_repaired_turns(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 4)
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes."), (1, 2, "user", "and"), (1, 3, "assistant", "Ok."),
            (1, 4, "assistant", "Ok."), (1, 5, "tool", "Ok!")]
    got = [tuple(r)[2:] for r in repair.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()]
    cost, audit = cheapest([r[2:] for r in rows], faults([r[2:] for r in rows]))
    assert "".join(g[0] for g in got) == audit
    assert "\n".join(f"{g[1]}:{g[2]}" for g in got if g[0] != "D") == applied([r[2:] for r in rows], audit)


def test_nothing_left_and_empty_table(spark):
    gone = next(c for c in count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    empty = hashlib.sha256().hexdigest()
    made = repair.with_all_conversations(repair.repair_conversations(repair.damage(rows)), rows)
    assert [tuple(r) for r in made.collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repair.repair_conversations(rows.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_conversation_repair"](spark, sf).collect()
    assert {tuple(r) for r in got} == brute(damaged(rows), rows)
