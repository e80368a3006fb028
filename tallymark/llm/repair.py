"""Conversation structure repair: the cheapest edits that give a well-formed order of roles.

A repair is a derivation of weighted deductions: an item (rows still to come, state) follows from the
item after an edit, at the cost of the edit. Knuth's agenda pops items in the order of (cost, audit)
until the goal is final. Costs never fall, and among edits of one item the first letter tells the
audits apart, as each letter leads to one item only; so an item needs a letter, not a string.

Conversations are numbered without any window over a hot one and cut into blocks of `BLOCK` rows. The
agenda runs in every block from each state to each state; the blocks of a conversation are then
themselves deductions of a second, short agenda.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import by_value
from tallymark.operators.ranking import position_in_group
from tallymark.session import cut, shared_path

BLOCK = 1024
RESEAT, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: States of a repaired prefix: nothing yet, then the initial of its last role.
STATES = ("", "s", "u", "a")
#: State after a role initial, and after the role that an inserted or changed row must have.
TAKES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEEDS = {"": "u", "s": "u", "u": "a", "a": "u"}
#: Inserts that end a conversation in each state.
ENDINGS = {"": "", "s": "II", "u": "I", "a": ""}
ROLES = {"u": "user", "a": "assistant"}
TRANSFER = "costs array<int>, ranks array<int>, audits array<string>"
PLAN = ("conv string, block bigint, way int, ending string, n_blank bigint, n_duplicate bigint, "
        "n_truncated bigint, illegal bigint, cost bigint")
RESULT = ("conv string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")


def lightest_derivations(axioms: list, deduce: Callable, goals: set) -> dict:
    """Finalised items `{item: (key, back)}`, popped by key until all goals are final.

    `axioms` are (key, item, back); `deduce(item, key)` gives those that follow, with keys above the
    item's own. The first key popped for an item is its least one.
    """
    agenda, final, left = list(axioms), {}, set(goals)
    heapq.heapify(agenda)
    while agenda and left:
        key, item, back = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (key, back)
        left.discard(item)
        for more in deduce(item, key):
            if more[1] not in final:
                heapq.heappush(agenda, more)
    return final


def row_edits(code: str) -> list[tuple[str, str, str, int]]:
    """(letter, state before, state after, cost) of the edits of a row.

    A code is `x` for a row that must go, else its role initial (`o`: any other), in upper case when
    the row is truncated.
    """
    edits = [("D", q, q, DELETE) for q in STATES]
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        edits += [("K", p, q, more) for (p, initial), q in TAKES.items() if initial == code.lower()]
        edits += [("R", p, q, RESEAT + more) for p, q in NEEDS.items()]
    return edits


EDITS = {code: row_edits(code) for code in "xsuaoSUAO"}


@lru_cache(maxsize=1 << 14)
def block_ways(codes: str) -> tuple[list, list, list]:
    """(costs, ranks, audits) by 4 * start + end of the cheapest edits of a block of rows.

    The agenda starts at the block's end in one state and goes back; items are (rows done, state).
    Inserts stand before a row, never after the last one. Costs are null where no edits lead from
    start to end; ranks order the audits of one start.
    """
    n = len(codes)
    goals = {(n, q) for q in STATES}

    def deduce(item, key):
        done, after = item
        if done < n:
            for letter, p, q, cost in EDITS[codes[n - 1 - done]]:
                if q == after:
                    yield (key[0] + cost, done + 1, letter, p), (done + 1, p), (letter, item)
        if done:
            for p, q in NEEDS.items():
                if q == after:
                    yield (key[0] + INSERT, done, "I", p), (done, p), ("I", item)

    costs, audits = [None] * 16, [None] * 16
    for e, end in enumerate(STATES):
        final = lightest_derivations([((0, 0, "", end), (0, end), None)], deduce, goals)
        for s, start in enumerate(STATES):
            if (n, start) in final:
                key, back = final[n, start]
                costs[4 * s + e], letters = key[0], []
                while back:
                    letters.append(back[0])
                    back = final[back[1]][1]
                audits[4 * s + e] = "".join(letters)
    ranks = []
    for s in range(4):
        order = sorted({a for a in audits[4 * s:4 * s + 4] if a is not None})
        ranks += [None if a is None else order.index(a) for a in audits[4 * s:4 * s + 4]]
    return costs, ranks, audits


def conversation_ways(blocks: list[tuple[list, list]]) -> tuple[int, list[int], str]:
    """(cost, way of each block, ending) of the cheapest repair of blocks of (costs, ranks)."""
    n = len(blocks)
    axioms = [((INSERT * len(t), 0, 0, q), (0, q), None) for q, t in ENDINGS.items()]

    def deduce(item, key):
        done, after = item
        if done < n:
            costs, ranks = blocks[n - 1 - done]
            for s, p in enumerate(STATES):
                way = 4 * s + STATES.index(after)
                if costs[way] is not None:
                    yield (key[0] + costs[way], done + 1, ranks[way], p), (done + 1, p), (way, item)

    final = lightest_derivations(axioms, deduce, {(n, "")})
    key, back = final[n, ""]
    ways, state = [], ""
    while back:
        ways.append(back[0])
        state = back[1][1]
        back = final[back[1]][1]
    return key[0], ways, ENDINGS[state]


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) of damaged rows; nulls read as one blank, turns stay null.

    The checksum of `conv_id:turn`, modulo 20, drops a row (0), empties its text (1), takes its
    sentence ends (2), repeats it (3) or makes its role `user` (4).
    """
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(shown(conv_id), F.lit(":"), shown(turn)).cast("binary")) % 20
    said = F.when(F.col("fate") == 1, "").when(
        F.col("fate") == 2, F.translate("said", ".!?", "")).otherwise(F.col("said"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), shown(role).alias("who"),
        shown(text).alias("said"), fate.alias("fate")
    ).where("fate <> 0").select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("who")).alias("role"),
        said.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _conv(conv_id: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit("n"))


def _conv_id(rows: DataFrame) -> Column:
    """The conversation id that a key stands for, in its own type."""
    own = rows.schema["conv_id"].dataType
    return F.when(F.col("conv") != "n", F.expr("substr(conv, 2)")).cast(own).alias("conv_id")


def place_rows(rows: DataFrame) -> DataFrame:
    """(conv, pos, block, turn, role, text), written once: rows by turn, nulls first, then role and text."""
    ordered = position_in_group(
        rows.select(_conv(F.col("conv_id")).alias("conv"), F.col("turn").isNotNull().alias("timed"),
                    "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                    F.coalesce("text", F.lit(" ")).alias("text")),
        ["conv"], ["timed", "turn", "role", "text"], "pos")
    path = shared_path(rows.sparkSession, "conversation-rows")
    ordered.select("conv", "pos", F.floor((F.col("pos") - 1) / BLOCK).alias("block"),
                   "turn", "role", "text").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def code_blocks(placed: DataFrame) -> DataFrame:
    """(conv, block, codes, initials, n_blank, n_duplicate, n_truncated): a row per block of rows."""
    end = F.rtrim("text", F.lit(BLANKS))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    first = placed.groupBy("conv", said.alias("said")).agg(F.min("pos").alias("pos")).select(
        "conv", "pos", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    facts = placed.select(
        "conv", "pos", "block", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"),
    ).join(first, ["conv", "pos"], "left")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    truncated = ~F.col("blank") & ~duplicate & F.col("open")
    code = F.when(F.col("blank") | duplicate, "x").when(
        truncated, F.upper("initial")).otherwise(F.col("initial"))
    row = F.struct("pos", code.alias("code"), "initial")
    return facts.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.count_if("blank").alias("n_blank"),
        F.count_if(duplicate).alias("n_duplicate"), F.count_if(truncated).alias("n_truncated"),
    ).select("conv", "block", F.array_join("rows.code", "").alias("codes"),
             F.array_join("rows.initial", "").alias("initials"), "n_blank", "n_duplicate", "n_truncated")


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [block_ways(c) for c in batch.column(batch.schema.get_field_index("codes")).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([f[0] for f in found], pa.list_(pa.int32())),
             pa.array([f[1] for f in found], pa.list_(pa.int32())),
             pa.array([f[2] for f in found], pa.list_(pa.string()))],
            names=[*batch.schema.names, "costs", "ranks", "audits"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            yield from batch.slice(start, 512).to_pylist()


def illegal_pairs(initials: str) -> int:
    return sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def _plans(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for conv, own in groupby(_rows(batches), lambda r: r["conv"]):
            blocks, names, before = [], [], ""
            sums = {"n_blank": 0, "n_duplicate": 0, "n_truncated": 0, "illegal": 0}
            for r in own:
                blocks.append((r["costs"], r["ranks"]))
                names.append(r["block"])
                for c in ("n_blank", "n_duplicate", "n_truncated"):
                    sums[c] += r[c]
                sums["illegal"] += illegal_pairs(before + r["initials"])
                before = r["initials"][-1]
            cost, ways, ending = conversation_ways(blocks)
            for i, (block, way) in enumerate(zip(names, ways)):
                end = i == len(ways) - 1
                made.append({"conv": conv, "block": block, "way": way, "ending": ending if end else "",
                             **({**sums, "cost": cost} if end else {})})
                if len(made) >= 4096:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return run


def plan_repairs(blocks: DataFrame) -> DataFrame:
    """(conv, block, audit, and the conversation's counts and cost on its last block)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*blocks.schema.fields, *_parse_datatype_string(TRANSFER).fields])
    ways = cut(blocks.mapInArrow(_transfers, schema))
    planned = ways.drop("codes", "audits").repartition("conv").sortWithinPartitions("conv", "block")
    plan = planned.mapInArrow(_plans(to_arrow_schema(_parse_datatype_string(PLAN))), PLAN)
    audit = F.concat(F.get("audits", F.col("way")), "ending")
    return plan.join(ways.select("conv", "block", "audits"), ["conv", "block"]).select(
        "conv", "block", audit.alias("audit"), F.floor(F.col("way") / 4).cast("int").alias("start"),
        "n_blank", "n_duplicate", "n_truncated", "illegal", "cost")


def apply_edits(audit: str, start: int, rows: Iterator) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of a block's rows and inserts, from a state on; deleted rows come as they are."""
    state = STATES[start]
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "K":
            state = TAKES[state, role[:1]]
        elif letter != "D":
            state = NEEDS[state]
            role = ROLES[state]
        yield letter, role, text


def _digests(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for conv, own in groupby(_rows(batches), lambda r: r["conv"]):
            digest, audit, last, empty = hashlib.sha256(), [], None, True
            for _, block in groupby(own, lambda r: r["block"]):
                last = next(block)  # the plan of the block, then its rows
                audit.append(last["audit"])
                given = ((r["role"], r["text"]) for r in block)
                for letter, role, text in apply_edits(last["audit"], last["start"], given):
                    if letter != "D":
                        digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                        empty = False
            made.append({"conv": conv, "blank": last["n_blank"], "duplicate": last["n_duplicate"],
                         "truncated": last["n_truncated"], "illegal": last["illegal"],
                         "cost": last["cost"], "audit": "".join(audit),
                         "repaired_sha256": digest.hexdigest()})
            if len(made) >= 1024:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return run


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    One row for each conversation of `rows(conv_id, turn, role, text)`; rows stand by turn, nulls
    first, then by role and text. Null roles and texts read as one blank; rows without a conversation
    are one conversation without an id. A conversation's audit and digest are single values, so one
    task makes them, from a stream of its blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    placed = place_rows(rows)
    plans = plan_repairs(code_blocks(placed))
    none = {c: F.lit(None).cast(k) for c, k in plans.dtypes if c not in ("conv", "block")}
    stream = plans.withColumns({"pos": F.lit(0).cast("bigint"), "role": F.lit(""), "text": F.lit("")}).unionByName(
        placed.select("conv", "block", "pos", "role", "text").withColumns(none))
    judged = stream.repartition("conv").sortWithinPartitions("conv", "block", "pos").mapInArrow(
        _digests(to_arrow_schema(_parse_datatype_string(RESULT))), RESULT)
    turn = F.col("turn").cast("bigint")
    gaps = placed.groupBy("conv").agg(F.coalesce(
        F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"))
    return judged.join(gaps, "conv").select(
        _conv_id(rows), "gaps", *[c.split()[0] for c in RESULT.split(", ")[1:]])


def with_all_conversations(found: DataFrame, rows: DataFrame) -> DataFrame:
    """`found` with a row for every conversation of `rows`: zeros and empty texts where none is left."""
    blank = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    every = rows.select("conv_id").distinct().withColumn("key", _conv(F.col("conv_id")))
    facts = [c for c in found.columns if c != "conv_id"]
    joined = every.join(found.withColumn("key", _conv(F.col("conv_id"))).drop("conv_id"), "key", "left")
    return joined.select("conv_id", *[
        F.coalesce(c, F.lit(blank[c]) if c in blank else F.lit(0).cast("bigint")).alias(c) for c in facts])


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): every row and insert of a repair, deleted rows included.

    `place` orders the edits of a conversation; see `repair_conversations` for nulls and order.
    """
    placed = place_rows(rows)
    plans = plan_repairs(code_blocks(placed)).select("conv", "block", "audit", "start")
    given = placed.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("given"))
    schema = "conv string, block bigint, step bigint, edit string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            own = iter([(g["role"], g["text"]) for g in r["given"]])
            made = list(apply_edits(r["audit"], r["start"], own))
            n = len(made)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["conv"]] * n, pa.string()), pa.array([r["block"]] * n, pa.int64()),
                 pa.array(range(n), pa.int64()), *[pa.array([m[i] for m in made], pa.string()) for i in range(3)]],
                names=["conv", "block", "step", "edit", "role", "text"])

    edits = plans.join(given, ["conv", "block"]).mapInArrow(run, schema)
    place = F.struct("block", "step").alias("place")  # a block has as many steps as its audit letters
    return edits.select(_conv_id(rows), place, "edit", "role", "text")


by_value(__name__)
