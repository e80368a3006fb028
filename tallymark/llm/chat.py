"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Messages are read into items: the message itself, each call it makes, each result it carries. Calls
and results meet in a hash join on conversation and call id, so a conversation of any length is
spread over tasks. Items are rows with a sortable place; no conversation is collected.

A call is `<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>` in an assistant's
text; a result is the text of a message of the role `tool`, `{"tool_call_id": ..., "content": ...}`.
Arguments cite the result of another call as `{"$ref": "call id"}`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import by_value
from tallymark.session import cut

#: JSON that is nested deeper is no call or result; it stays text.
MOST_DEPTH = 200
LONE_HALF = re.compile("[\ud800-\udfff]")
CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
#: Argument schemas by tool: types, required names, allowed values, bounds.
SCHEMAS = {
    "search": {"required": ["query"], "properties": {
        "query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1},
        "after": {"type": "object"}, "sort": {"type": "string", "enum": ["date", "rank"]}}},
    "lookup": {"required": ["key"], "properties": {
        "key": {"type": "string"}, "exact": {"type": "boolean"}, "after": {"type": "object"}}},
}
TYPES = {
    "string": str, "object": dict, "array": list, "boolean": bool, "integer": int,
    "number": (int, float), "null": type(None),
}
ITEMS = ("conv_id bigint, turn bigint, seq int, kind string, call_id string, name string, "
         "refs array<string>, errors array<string>, json string")
#: Calls of a conversation that one task orders.
TASK_CALLS = 100_000
#: Above the hops of any chain of calls; keeps the counters of cycles in range.
MOST_HOPS = 1 << 40


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; whole floats as integers, no escapes of plain letters."""
    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float) and v.is_integer() and abs(v) < 2 ** 53:
            return int(v)
        return v

    return escaped(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def escaped(text: str) -> str:
    """Halves of surrogate pairs that stand alone as JSON escapes, since UTF-8 has no place for them."""
    return LONE_HALF.sub(lambda half: f"\\u{ord(half[0]):04x}", text)


def depth_of(value) -> int:
    """How deep lists and objects are nested."""
    deepest, pending = 0, [(value, 1)]
    while pending:
        v, depth = pending.pop()
        if isinstance(v, (dict, list)):
            deepest = max(deepest, depth)
            pending += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


def strict_json(text: str):
    """The value of a JSON text. Names that JSON does not know, like NaN, numbers beyond the range of a
    float and values nested deeper than `MOST_DEPTH` are errors."""
    def refuse(name):
        raise ValueError(name)

    def finite(digits):
        number = float(digits)
        return refuse(digits) if number in (float("inf"), float("-inf")) else number

    value = json.loads(text, parse_constant=refuse, parse_float=finite)
    return refuse("too deep") if depth_of(value) > MOST_DEPTH else value


def value_errors(path: str, value, rule: dict) -> list[str]:
    """What is wrong with a value: its type, allowed values, bounds, pattern, members or items.

    A cited result stands for a value of any type; `5.0` is an integer, as it is written as `5`.
    """
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kind, is_flag = rule.get("type"), isinstance(value, bool)
    whole = kind == "integer" and isinstance(value, float) and value.is_integer()
    if kind and not whole and (not isinstance(value, TYPES[kind]) or is_flag and kind != "boolean"):
        return [f"{path}: not {kind}"]
    if "enum" in rule and value not in rule["enum"]:
        return [f"{path}: not allowed"]
    errors = []
    if isinstance(value, (int, float)) and not is_flag:
        errors += [f"{path}: too small"] * (value < rule.get("minimum", value))
        errors += [f"{path}: too large"] * (value > rule.get("maximum", value))
    if isinstance(value, str) and not re.search(rule.get("pattern", ""), value):
        errors.append(f"{path}: no match")
    if isinstance(value, dict) and "properties" in rule:
        errors += member_errors(f"{path}.", value, rule)
    if isinstance(value, list) and "items" in rule:
        errors += [e for i, v in enumerate(value) for e in value_errors(f"{path}[{i}]", v, rule["items"])]
    return errors


def member_errors(prefix: str, value: dict, schema: dict) -> list[str]:
    known = schema.get("properties", {})
    errors = [f"{prefix}{name}: missing" for name in schema.get("required", []) if name not in value]
    for name, v in value.items():
        errors += value_errors(prefix + name, v, known[name]) if name in known else [f"{prefix}{name}: unknown"]
    return errors


def argument_errors(arguments, schema: dict) -> list[str]:
    """What is wrong with the arguments, sorted; members of members are named by their path."""
    if not isinstance(arguments, dict):
        return ["arguments: not an object"]
    return sorted(escaped(e) for e in member_errors("", arguments, schema))


def references(value) -> list[str]:
    """Call ids that the arguments cite, without repeats."""
    found, pending = set(), [value]
    while pending:
        v = pending.pop()
        if isinstance(v, dict):
            if set(v) == {"$ref"} and isinstance(v["$ref"], str):
                found.add(escaped(v["$ref"]))
            pending += v.values()
        elif isinstance(v, list):
            pending += v
    return sorted(found)


def items_of(role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """(seq, kind, call_id, name, refs, errors, json) of one message.

    A call or result that is no valid JSON object with an id stays text of its message.
    """
    text = text or ""
    items: list[tuple] = []
    if role == "tool":
        try:
            body = strict_json(text)
            if isinstance(body, dict) and isinstance(body.get("tool_call_id"), str):
                made = canonical({"content": body.get("content"), "role": "tool",
                                  "tool_call_id": body["tool_call_id"]})
                return [(0, "result", escaped(body["tool_call_id"]), None, [], [], made)]
        except (ValueError, RecursionError):
            pass

    def take(match: re.Match) -> str:
        try:
            call = strict_json(match[1])
        except (ValueError, RecursionError):
            return match[0]
        if not isinstance(call, dict) or not isinstance(call.get("id"), str):
            return match[0]
        name, arguments = call.get("name"), call.get("arguments", {})
        known = isinstance(name, str) and name in schemas
        errors = argument_errors(arguments, schemas[name]) if known else ["tool: unknown"]
        items.append((len(items) + 1, "call", escaped(call["id"]), escaped(name) if isinstance(name, str) else None,
                      references(arguments), errors,
                      canonical({"arguments": arguments, "id": call["id"], "name": name})))
        return ""

    content = CALL.sub(take, text) if role == "assistant" else text
    return [(0, "message", None, None, [], [], canonical({"content": content, "role": role})), *items]


def read_items(messages: DataFrame, schemas: dict) -> DataFrame:
    """Items of messages(conv_id, turn, role, text), in one pass without a shuffle."""
    source = messages.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"),
        F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                rows = [(conv, turn, *item)
                        for conv, turn, role, text in zip(*[c.to_pylist() for c in part.columns],
                                                          strict=True)
                        for item in items_of(role, text, schemas)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(),
                         pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
                names = ["conv_id", "turn", "seq", "kind", "call_id", "name", "refs", "errors", "json"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return source.mapInArrow(run, ITEMS)


def call_places(calls: dict[str, tuple[int, list[str]]]) -> dict[str, tuple[int, int, bool]]:
    """(at, hops, settled) by call id of one conversation's `{id: (turn, cited ids)}`.

    A call is placed once all calls that it cites are; ids that no call has are not waited for.
    """
    waits = {c: len({r for r in refs if r in calls}) for c, (_, refs) in calls.items()}
    cited_by: dict[str, list[str]] = {}
    for c, (_, refs) in calls.items():
        for r in set(refs):
            if r in calls:
                cited_by.setdefault(r, []).append(c)
    places = {c: (turn, 0) for c, (turn, _) in calls.items()}
    ready, settled = [c for c, n in waits.items() if not n], set()
    while ready:
        c = ready.pop()
        settled.add(c)
        at, hops = places[c]
        for later in cited_by.get(c, ()):
            places[later] = max(places[later], (at, hops + 1))
            waits[later] -= 1
            if not waits[later]:
                ready.append(later)
    return {c: (*places[c], True) if c in settled else (turn, 0, False) for c, (turn, _) in calls.items()}


def _placed_in_tasks(calls: DataFrame) -> DataFrame:
    """`_ordered_calls` where every conversation is read by one task."""
    kind = calls.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        for conv, own in groupby(rows(), lambda r: r[0]):
            places = call_places({call: (turn, refs) for _, call, turn, refs in own})
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(places), pa.int64()), pa.array(list(places), pa.string()),
                 *[pa.array([p[i] for p in places.values()], t)
                   for i, t in enumerate((pa.int64(), pa.int32(), pa.bool_()))]],
                names=["conv_id", "call_id", "at", "hops", "settled"])

    return calls.select("conv_id", "call_id", F.col("turn").cast("bigint"), "refs").repartition(
        "conv_id").sortWithinPartitions("conv_id").mapInArrow(
        run, f"conv_id {kind}, call_id string, at bigint, hops int, settled boolean")


def _ordered_calls(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, hops, settled): where each call may stand.

    Conversations of up to `TASK_CALLS` calls are ordered by a task each, larger ones by all tasks in
    rounds; both give the same places.
    """
    calls = cut(calls)
    large = cut(calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > TASK_CALLS).select("conv_id"))
    if large.isEmpty():
        return _placed_in_tasks(calls)
    # Fewer conversations than calls divided by `TASK_CALLS`.
    return _placed_in_tasks(calls.join(large, "conv_id", "left_anti")).unionByName(
        _placed_in_rounds(calls.join(large, "conv_id", "left_semi")))


def _placed_in_rounds(calls: DataFrame) -> DataFrame:
    """`_ordered_calls` where tasks share a conversation.

    A call stands at its own turn, or behind the call it cites where that one comes later: `at` is
    then the other's turn and `hops` one more than the other's. In a round every open citation takes
    over what its call knows and is closed if that call has settled; a citation of a call with one
    open citation is led on to the call behind it. Chains of calls with one citation each so settle
    in rounds that grow with the logarithm of their length, others in no more rounds than their
    length. Calls of which no citation chain ends settle in no round: rounds end when nothing is open
    or none has settled, and the open calls are then in a cycle or behind one and keep their own turn.
    """
    key = ["conv_id", "call_id"]
    own = F.struct(F.col("turn").cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("hops"))
    citations = F.transform("refs", lambda r: F.struct(r.alias("ref"), F.lit(1).cast("bigint").alias("hops")))
    state = cut(calls.select(*key, "turn", own.alias("place"), citations.alias("open")))
    settled = state.where(F.size("open") == 0)
    pending, left = state.where(F.size("open") > 0), state.where(F.size("open") > 0).count()
    if left:
        cited = pending.select("conv_id", F.explode("open.ref").alias("call_id")).distinct()
        known = cut(settled.join(cited, key, "left_semi"))
    rounds = 0
    while left:
        before = known.unionByName(pending).select(
            "conv_id", F.col("call_id").alias("ref"), F.col("place").alias("there"),
            F.col("open").alias("next"))
        hops = lambda a, b: F.least(a + b, F.lit(MOST_HOPS)).alias("hops")
        met = pending.select(*key, "turn", "place", F.explode("open").alias("cite")).select(
            *key, "turn", "place", "cite.ref", F.col("cite.hops").alias("by")
        ).join(before, ["conv_id", "ref"], "left").select(
            *key, "turn", "place",
            F.when(F.col("there").isNotNull(), F.struct(
                F.col("there.at").alias("at"), hops(F.col("there.hops"), F.col("by")))).alias("bound"),
            F.when(F.size("next") == 1, F.struct(
                F.get("next", F.lit(0)).ref.alias("ref"), hops(F.get("next", F.lit(0)).hops, F.col("by"))))
            .when(F.size("next") > 1, F.struct("ref", F.col("by").alias("hops"))).alias("open"))
        moved = cut(met.groupBy(*key).agg(
            F.first("turn").alias("turn"), F.greatest(F.first("place"), F.max("bound")).alias("place"),
            F.collect_list("open").alias("open")
        ).withColumn("open", F.transform(F.array_distinct("open.ref"), lambda r: F.struct(
            r.alias("ref"), F.array_max(F.transform(
                F.filter("open", lambda o: o.ref == r), lambda o: o.hops)).alias("hops")))))
        done = moved.where(F.size("open") == 0)
        settled, known = settled.unionByName(done), known.unionByName(done)
        pending, was = moved.where(F.size("open") > 0), left
        left, rounds = pending.count(), rounds + 1
        if left == was:
            break
        if rounds % 8 == 0:  # keeps the plan small
            settled, known = cut(settled), cut(known)
    placed = settled.select(*key, "place.at", F.col("place.hops").cast("int").alias("hops"),
                            F.lit(True).alias("settled"))
    return placed.unionByName(pending.select(
        *key, F.col("turn").cast("bigint").alias("at"), F.lit(0).alias("hops"), F.lit(False).alias("settled")))


def format_chats(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """(conv_id, turn, seq, kind, call_id, name, status, errors, at, hops, step, json), a row per item.

    Ordered by (at, hops, step, turn, seq), every call of a conversation comes after the results it
    cites and every result after its call. Status of a call: `ok`, `invalid` (see `errors`),
    `duplicate` (its id is taken by an earlier call), `no_result`, `cyclic` (it cites itself through
    others, or a call that does); of a result: `linked` or `orphan`. A message has the status `message`. The first call with an id, by turn and place, owns
    it; all results with the id are its results. Null texts are empty messages, null turns come first,
    rows without a conversation id form one conversation, repeated rows repeat their items. An empty
    table gives no rows.
    """
    items = read_items(messages.withColumn("conv_id", F.coalesce("conv_id", F.lit(-1))), schemas)
    facts = cut(items.where("call_id IS NOT NULL").select(
        "conv_id", "call_id", "kind", F.coalesce("turn", F.lit(-1)).alias("turn"), "seq", "refs"))
    calls, results = facts.where("kind = 'call'"), facts.where("kind = 'result'")
    owners = calls.groupBy("conv_id", "call_id").agg(
        F.min_by(F.struct("turn", "seq", "refs"), F.struct("turn", "seq")).alias("own"))
    owners = owners.select("conv_id", "call_id", "own.turn", "own.seq", "own.refs")
    answered = results.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("results"))
    linked = cut(
        owners.join(answered.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
        .join(_ordered_calls(owners), ["conv_id", "call_id"])
        .select("conv_id", "call_id", F.col("turn").alias("own_turn"), F.col("seq").alias("own_seq"),
                "results", "at", "hops", "settled"))
    joined = items.join(linked, ["conv_id", "call_id"], "left")
    turn = F.coalesce("turn", F.lit(-1))
    first = (turn == F.col("own_turn")) & (F.col("seq") == F.col("own_seq"))
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(F.col("kind") == "result", F.when(F.col("at").isNull(), "orphan").otherwise("linked"))
        .when(~first, "duplicate").when(F.size("errors") > 0, "invalid")
        .when(~F.col("settled"), "cyclic").when(F.col("results").isNull(), "no_result")
        .otherwise("ok"))
    # A result stands at its own turn unless its call stands later.
    after_call = F.when(F.struct(turn, F.lit(0)) >= F.struct("at", "hops"),
                        F.struct(turn.alias("at"), F.lit(0).alias("hops"))).otherwise(
        F.struct(F.col("at").alias("at"), F.col("hops").alias("hops")))
    at_turn = F.struct(turn.alias("at"), F.lit(0).alias("hops"))
    place = F.when((F.col("kind") == "call") & F.col("settled"),
                   F.struct(F.col("at").alias("at"), F.col("hops").alias("hops"))).when(
        (F.col("kind") == "result") & F.col("at").isNotNull(), after_call).otherwise(at_turn)
    step = F.when(F.col("kind") == "result", 2).when(F.col("kind") == "call", 1).otherwise(0)
    return joined.withColumn("place", place).select(
        "conv_id", "turn", "seq", "kind", "call_id", "name", status.alias("status"), "errors",
        F.col("place.at").alias("at"), F.col("place.hops").alias("hops"), step.alias("step"), "json")


def with_tool_use(conversations: DataFrame) -> DataFrame:
    """Conversations as tool dialogues: every assistant turn also calls a tool with the turn's text.

    The tables at hand have no tool calls. In every third conversation each call cites the one two
    turns after it, a chain against the order of turns that is as long as the conversation; in the
    others every second call cites the one two turns before it. The next user turn is a call's
    result, so ids, links and order follow from the rows of the table.
    """
    call_id = F.concat(F.lit("c"), F.col("turn").cast("string"))
    cited = F.when(F.col("conv_id") % 3 == 0, F.col("turn") + 2).when(
        F.col("turn") % 4 == 3, F.col("turn") - 2)
    cites = F.when(cited.isNotNull(), F.named_struct(
        F.lit("$ref"), F.concat(F.lit("c"), cited.cast("string"))))
    search = F.to_json(F.struct(
        call_id.alias("id"), F.lit("search").alias("name"), F.struct(
            F.col("text").alias("query"), (F.col("turn") % 7).alias("limit"),
            cites.alias("after")).alias("arguments")))
    lookup = F.to_json(F.struct(
        call_id.alias("id"), F.lit("lookup").alias("name"), F.struct(
            F.col("text").alias("key"), F.lit(True).alias("exact"),
            cites.alias("after")).alias("arguments")))
    call = F.when(F.col("turn") % 3 == 0, lookup).otherwise(search)
    result = F.to_json(F.struct(
        F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"),
        F.col("text").alias("content")))
    asks = F.col("role") == "assistant"
    answers = (F.col("role") == "user") & (F.col("turn") > 1)
    return conversations.select(
        "conv_id", "turn", F.when(answers, "tool").otherwise(F.col("role")).alias("role"),
        F.when(asks, F.concat("text", F.lit("<tool_call>"), call, F.lit("</tool_call>")))
        .when(answers, result).otherwise(F.col("text")).alias("text"))


by_value(__name__)
