import json
import random

from tallymark.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, json string"


def call(cid, name="search", **arguments):
    return "<tool_call>" + json.dumps({"id": cid, "name": name, "arguments": arguments}) + "</tool_call>"


def result(cid, content="r"):
    return json.dumps({"tool_call_id": cid, "content": content})


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = chat.format_chats(df).collect()
    return sorted(got, key=lambda r: (r["conv_id"], r["at"], r["hops"], r["step"], r["turn"] or -1, r["seq"]))


def test_links_and_statuses(spark):
    rows = formatted(spark, [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a " + call("x", query="q", limit=2) + call("y", "nope")),
        (1, 2, "tool", result("x")), (1, 3, "tool", result("zz")), (1, 4, "assistant", call("x", query="again")),
        (1, 5, "assistant", call("w", query=5, odd=1, limit=0, sort="up")), (2, 0, "tool", result("x")),
        (2, 1, "assistant", call("v", query="q")), (3, 0, "assistant", "<tool_call>{broken</tool_call>"),
        (3, 1, "tool", "no json"), (3, None, None, None), (None, 2, "user", "")])
    status = {(r["conv_id"], r["turn"], r["seq"]): (r["kind"], r["status"]) for r in rows}
    assert status[1, 1, 1] == ("call", "ok") and status[1, 1, 2] == ("call", "invalid")
    assert status[1, 2, 0] == ("result", "linked") and status[1, 3, 0] == ("result", "orphan")
    assert status[1, 4, 1] == ("call", "duplicate") and status[1, 5, 1] == ("call", "invalid")
    assert status[2, 0, 0] == ("result", "orphan") and status[2, 1, 1] == ("call", "no_result")
    assert status[3, 0, 0] == ("message", "message") and status[3, 1, 0] == ("message", "message")
    assert status[3, None, 0] == ("message", "message") and status[-1, 2, 0] == ("message", "message")
    bad = next(r for r in rows if (r["turn"], r["call_id"]) == (5, "w"))
    assert bad["errors"] == ["limit: too small", "odd: unknown", "query: not string", "sort: not allowed"]


def test_order_follows_citations(spark):
    cites = lambda c: {"$ref": c}
    rows = formatted(spark, [
        (1, 0, "assistant", call("a", query="1", after=cites("c"))),
        (1, 1, "assistant", call("b", query="2", after=cites("a"))),
        (1, 2, "assistant", call("c", query="3")), (1, 3, "tool", result("a")), (1, 4, "tool", result("c")),
        (2, 0, "assistant", call("p", query="1", after=cites("q")) + call("q", query="2", after=cites("p"))),
        (2, 1, "tool", result("p")), (2, 2, "tool", result("q"))])
    order = [r["call_id"] for r in rows if r["conv_id"] == 1 and r["kind"] == "call"]
    assert order == ["c", "a", "b"]
    for conv in (1, 2):
        own = [(r["kind"], r["call_id"]) for r in rows if r["conv_id"] == conv]
        for kind, cid in own:
            if kind == "result":
                assert own.index(("call", cid)) < own.index((kind, cid))
    assert {r["status"] for r in rows if r["conv_id"] == 2 and r["kind"] == "call"} == {"cyclic"}


def test_canonical_json():
    assert chat.canonical({"b": [1.0, {"z": None, "a": "é"}], "a": 1e300}) == '{"a":1e+300,"b":[1,{"a":"é","z":null}]}'
    a, b = '{"x": {"b":1,"a":2}, "y":1.0}', '{"y":1,"x":{"a":2,"b":1}}'
    assert chat.canonical(json.loads(a)) == chat.canonical(json.loads(b))
    assert json.loads(chat.canonical(json.loads(a))) == json.loads(a)


def test_query_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = chat.format_chats(chat.with_tool_use(table)).collect()
    talk = {(r["conv_id"], r["turn"]): r for r in table.collect()}
    calls = {k for k, r in talk.items() if r["role"] == "assistant"}
    answers = {k for k, r in talk.items() if r["role"] == "user" and r["turn"] > 1}
    assert {(r["conv_id"], r["turn"]) for r in rows if r["kind"] == "call"} == calls
    for r in rows:
        body = json.loads(r["json"])
        text = talk[r["conv_id"], r["turn"]]["text"]
        if r["kind"] == "message":
            assert body["content"] == text
        elif r["kind"] == "result":
            assert body["content"] == text and (r["conv_id"], r["turn"]) in answers
            linked = (r["conv_id"], r["turn"] - 1) in calls
            assert r["status"] == ("linked" if linked else "orphan")
        else:
            assert text in body["arguments"].values()
            assert r["json"] == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_empty_table(spark):
    assert formatted(spark, []) == []


def test_long_chains_against_the_order_of_turns(spark):
    n = 130
    chain = [(1, t, "assistant", call(f"c{t}", query="q", after={"$ref": f"c{t + 1}"})) for t in range(n)]
    # Each call cites the next two: more open citations than one.
    wide = [(2, t, "assistant", call(f"c{t}", query="q", after={"x": {"$ref": f"c{t + 1}"}, "y": {"$ref": f"c{t + 2}"}}))
            for t in range(12)]
    ring = [(3, t, "assistant", call(f"c{t}", query="q", after={"$ref": f"c{(t + 1) % 7}"})) for t in range(7)]
    ring += [(3, 7, "assistant", call("free", query="q")), (3, 8, "assistant", call("self", query="q", after={"$ref": "self"}))]
    rows = [r for r in formatted(spark, chain + wide + ring) if r["kind"] == "call"]
    assert [r["call_id"] for r in rows if r["conv_id"] == 1] == [f"c{t}" for t in reversed(range(n))]
    assert [r["call_id"] for r in rows if r["conv_id"] == 2] == [f"c{t}" for t in reversed(range(12))]
    assert {r["status"] for r in rows if r["conv_id"] in (1, 2)} == {"no_result"}
    assert [(r["at"], r["hops"]) for r in rows if r["conv_id"] == 1] == [(n - 1, k) for k in range(n)]
    status = {r["call_id"]: (r["status"], r["at"], r["hops"]) for r in rows if r["conv_id"] == 3}
    assert status == {**{f"c{t}": ("cyclic", t, 0) for t in range(7)}, "free": ("no_result", 7, 0), "self": ("cyclic", 8, 0)}


def test_query_reorders_calls(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [r for r in chat.format_chats(chat.with_tool_use(table)).collect() if r["kind"] == "call"]
    assert "cyclic" not in {r["status"] for r in rows} and max(r["hops"] for r in rows) > 1
    by_id = {(r["conv_id"], r["call_id"]): (r["at"], r["hops"]) for r in rows if r["status"] != "duplicate"}
    for r in rows:
        after = json.loads(r["json"])["arguments"].get("after")
        cited = after and by_id.get((r["conv_id"], after["$ref"]))
        if cited and r["status"] != "duplicate":
            assert cited < by_id[r["conv_id"], r["call_id"]]


def test_awkward_json_ends_no_job(spark):
    deep = '{"a":' * 2000 + "1" + "}" * 2000
    rows = formatted(spark, [
        (1, 0, "assistant", '<tool_call>{"id":"\\ud83d","name":"search","arguments":{"query":"\\udc00 \\ud83d\\ude00"}}</tool_call>'),
        (1, 1, "tool", '{"tool_call_id":"\\ud83d","content":"x\\ud800"}'),
        (2, 0, "assistant", '<tool_call>{"id":"d","name":"search","arguments":' + deep + "}</tool_call>"),
        (2, 1, "tool", '{"tool_call_id":"d","content":' + deep + "}"),
        (3, 0, "assistant", '<tool_call>{"id":"n","name":"search","arguments":{"query":1e999}}</tool_call>'),
        (3, 1, "assistant", '<tool_call>{"id":"m","name":"search","arguments":{"query":"q","limit":5.0,"\\ud800":1}}</tool_call>')])
    kinds = {(r["conv_id"], r["turn"], r["seq"]): (r["kind"], r["status"]) for r in rows}
    assert kinds[1, 0, 1] == ("call", "ok") and kinds[1, 1, 0] == ("result", "linked")
    made = {(r["conv_id"], r["turn"], r["seq"]): r["json"] for r in rows}
    assert json.loads(made[1, 0, 1])["arguments"] == {"query": "\udc00 😀"} and "\\udc00 😀" in made[1, 0, 1]
    assert json.loads(made[1, 1, 0])["content"] == "x\ud800"
    assert [k for k in kinds if k[0] == 2] == [(2, 0, 0), (2, 1, 0)] and kinds[2, 1, 0][0] == "message"
    assert (3, 0, 1) not in kinds and "1e999" in made[3, 0, 0]
    assert [r["errors"] for r in rows if (r["conv_id"], r["turn"], r["seq"]) == (3, 1, 1)] == [["\\ud800: unknown"]]


def test_nested_schemas():
    schema = {"required": ["who"], "properties": {
        "who": {"type": "object", "required": ["name"], "properties": {
            "name": {"type": "string", "pattern": "^[a-z]+$"}, "age": {"type": "integer", "minimum": 0, "maximum": 150}}},
        "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}}}
    good = {"who": {"name": "ann", "age": 5.0}, "tags": ["a", {"$ref": "x"}]}
    assert chat.argument_errors(good, schema) == []
    bad = {"who": {"name": "Ann", "age": 151, "x": 1}, "tags": ["a", "c", 5]}
    assert chat.argument_errors(bad, schema) == [
        "tags[1]: not allowed", "tags[2]: not string", "who.age: too large", "who.name: no match", "who.x: unknown"]
    assert chat.argument_errors({"who": {"age": -1.5}}, schema) == ["who.age: not integer", "who.name: missing"]
    deep = chat.strict_json("[" * 200 + "]" * 200)
    assert chat.depth_of(deep) == 200 and len(chat.canonical(deep)) == 400


def test_tasks_and_rounds_place_calls_alike(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for conv in range(30):
        n = rng.randrange(1, 25)
        for c in range(n):
            refs = [f"c{rng.randrange(n + 2)}" for _ in range(rng.randrange(0, 3))] if rng.random() < 0.6 else []
            rows.append((conv, f"c{c}", rng.randrange(9), sorted(set(refs))))
    calls = spark.createDataFrame(rows, "conv_id bigint, call_id string, turn bigint, refs array<string>")
    in_tasks = {tuple(r) for r in chat._ordered_calls(calls).collect()}
    monkeypatch.setattr(chat, "TASK_CALLS", 8)
    assert {tuple(r) for r in chat._ordered_calls(calls).collect()} == in_tasks
    assert any(not r[4] for r in in_tasks) and any(r[3] > 1 for r in in_tasks)


def test_a_long_chain_with_two_citations_each(spark):
    n = 10_000
    rows = [(1, f"c{i}", n - i, [f"c{j}" for j in (i - 1, i - 2) if j >= 0]) for i in range(n)]
    calls = spark.createDataFrame(rows, "conv_id bigint, call_id string, turn bigint, refs array<string>")
    got = {r["call_id"]: (r["at"], r["hops"], r["settled"]) for r in chat._ordered_calls(calls).collect()}
    assert got == {f"c{i}": (n, i, True) for i in range(n)}
