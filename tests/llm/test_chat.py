from __future__ import annotations

import json
import random

import duckdb
import pytest

from tessitura.llm import chat


def call(i, name="search", **arguments):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": arguments}) + "</tool_call>"


def result(i, content):
    return json.dumps({"id": i, "content": content})


def test_linking_order_and_validation(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "ok " + call("b", query={"$result": "a"}) + call("a", query="x", limit=2.0)),
        (1, 2, "tool", result("a", {"z": 1, "y": [1.0, None]})),
        (1, 3, "tool", result("orphan", 1)),
        (1, 4, "assistant", call("c", "nothing") + call("d", query="", more=1) + "<tool_call>broken</tool_call>"),
        (2, None, None, None),
        (None, 1, "user", "naïve \"q\"\n"),
        (None, 1, "user", "naïve \"q\"\n"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, seq int")
    got = {r["conv_id"]: r for r in chat.format_chats(df, chat.TOOLS).collect()}
    one = json.loads(got[1]["chat"])
    assert (got[1]["n_messages"], got[1]["n_calls"], got[1]["n_results"], got[1]["n_linked"], got[1]["n_invalid"]) == (5, 4, 2, 1, 2)
    assert one["call_order"] == ["a", "b", "c", "d"] and one["cyclic"] is False
    calls = one["messages"][1]["tool_calls"]
    assert calls[1] == {"arguments": {"limit": 2, "query": "x"}, "errors": [], "id": "a", "name": "search", "result": {"y": [1, None], "z": 1}} and calls[0]["result"] is None
    assert one["messages"][3]["tool_results"] == [{"content": 1, "id": "orphan"}] and "tool_results" not in one["messages"][2]
    assert one["messages"][4]["content"] == "<tool_call>broken</tool_call>"
    assert [c["errors"] for c in one["messages"][4]["tool_calls"]] == [["no such tool"], ["$.more: unknown", "$.query: minLength 1"]]
    assert got[2]["chat"] == '{"messages":[{"content":null,"role":null,"turn":null}]}'
    assert got[None]["n_messages"] == 2 and '"naïve \\"q\\"\\n"' in got[None]["chat"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_repeated_ids_link_in_order(spark):
    rows = [(1, 0, "assistant", call("a", query="1") + call("a", query="2")), (1, 1, "tool", result("a", "r1")), (1, 2, "tool", result("a", "r2"))]
    out = json.loads(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), chat.TOOLS).first()["chat"])
    assert [c["result"] for c in out["messages"][0]["tool_calls"]] == ["r1", "r2"]


@pytest.mark.parametrize(("deps", "order", "cyclic"), [({"a": [], "b": ["c"], "c": []}, "acb", False), ({"a": ["b"], "b": ["a"], "c": []}, "cab", True), ({"a": ["a"]}, "a", False)])
def test_topological(deps, order, cyclic):
    calls = [{"id": k, "uses": v} for k, v in deps.items()]
    places, found = chat.topological(calls)
    assert ("".join(calls[i]["id"] for i in places), found) == (order, cyclic)


def test_schemas():
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "items": {"enum": ["x"]}}}, "required": ["n"]}
    assert chat.violations({"n": 2, "tags": ["x"]}, schema) == []
    assert chat.violations({"n": 0, "tags": ["y"]}, schema) == ["$.n: minimum 1", "$.tags[0]: not one of the values"]
    assert chat.violations({"n": True}, schema) == ["$.n: not of type integer"] and chat.violations({}, schema) == ["$.n: missing"] and chat.violations([], schema)
    assert chat.canonical({"b": 1.0, "a": [float("nan"), "é/"]}) == '{"a":[null,"é/"],"b":1}'


def test_data_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    assert sorted(map(tuple, chat.op5_chat(spark, "/root/testdata/sf0.01").collect())) == sorted(duck.sql(chat.OP5_SQL).fetchall())


def made(rng, conv):
    """A conversation with calls, results in any order, repeated and unknown identifiers, references and broken arguments."""
    names = [f"id{k}" for k in range(rng.randint(1, 4))]
    for turn in range(rng.randint(1, 6)):
        if rng.random() < 0.5:
            body = []
            for _ in range(rng.randint(0, 3)):
                arguments = rng.choice([{"query": "x"}, {"query": ""}, {"limit": 5}, {"query": "x", "limit": rng.choice([1, 2.0, 101, True, "7"])}, {"query": {"$result": rng.choice(names)}}])
                body.append(call(rng.choice(names), rng.choice(["search", "search", "calculate", "unknown"]), **arguments))
            yield conv, turn, "assistant", " and ".join(body)
        else:
            yield conv, turn, "tool", result(rng.choice([*names, "other"]), rng.randint(0, 99))


def brute_valid(name, arguments):
    if name not in chat.TOOLS:
        return False
    ref = lambda v: isinstance(v, dict)
    if name == "calculate":
        return set(arguments) == {"expression"}
    q, n = arguments.get("query"), arguments.get("limit", 1)
    return q is not None and (ref(q) or len(q) > 0) and isinstance(n, int | float) and not isinstance(n, bool) and n == int(n) and 1 <= n <= 100


def brute_chat(rows):
    """The k-th result of an identifier belongs to its k-th call; calls in the order in which they can be made."""
    calls, results = [], []
    for _, turn, role, text in rows:
        if role == "tool":
            results.append((json.loads(text)["id"], json.loads(text)["content"], turn))
        else:
            calls += [(c["id"], c["name"], c["arguments"]) for c in map(json.loads, chat.re.findall(r"<tool_call>(.*?)</tool_call>", text))]
    waiting, linked = list(results), []
    for i, _, _ in calls:
        found = next((r for r in waiting if r[0] == i), None)
        if found:
            waiting.remove(found)
        linked.append(found and found[1])
    first = {i: k for k, (i, _, _) in reversed(list(enumerate(calls)))}
    needs = [{first[v["$result"]] for v in a.values() if isinstance(v, dict) and v["$result"] in first} - {k} for k, (_, _, a) in enumerate(calls)]
    order = []
    while True:
        ready = [k for k in range(len(calls)) if k not in order and needs[k] <= set(order)]
        if not ready:
            break
        order.append(ready[0])
    cyclic = len(order) < len(calls)
    order += [k for k in range(len(calls)) if k not in order]
    return linked, [calls[k][0] for k in order], cyclic, [brute_valid(n, a) for _, n, a in calls], sorted((i, c) for i, c, _ in waiting)


def test_made_conversations_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [r for conv in range(2000) for r in made(rng, conv)]
    shuffled = rng.sample(rows, len(rows))
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(shuffled, "conv_id long, turn int, role string, text string"), chat.TOOLS).collect()}
    assert len(got) == 2000 and sum(r["n_linked"] for r in got.values()) > 500
    for conv in range(2000):
        linked, order, cyclic, valid, loose = brute_chat([r for r in rows if r[0] == conv])
        out = json.loads(got[conv]["chat"])
        calls = [c for m in out["messages"] for c in m.get("tool_calls", ())]
        assert [c["result"] for c in calls] == linked and [not c["errors"] for c in calls] == valid
        assert (out.get("call_order", []), out.get("cyclic", False)) == (order, cyclic)
        assert sorted((r["id"], r["content"]) for m in out["messages"] for r in m.get("tool_results", ())) == loose
        assert (got[conv]["n_calls"], got[conv]["n_linked"], got[conv]["n_invalid"]) == (len(calls), sum(x is not None for x in linked), valid.count(False))


def test_hostile_messages(spark):
    deep = "<tool_call>" + '{"id":"a","name":"search","arguments":' + "[" * 100_000 + "]" * 100_000 + "}</tool_call>"
    less = "<tool_call>" + '{"id":"a","name":"search","arguments":' + "[" * 500 + "]" * 500 + "}</tool_call>"
    rows = [
        (1, 0, "assistant", call("a", query="x", limit=int("9" * 400))),
        (2, 0, "assistant", deep),
        (3, 0, "assistant", less),
        (4, 0, "assistant", '<tool_call>{"id":"\\ud800","name":"search","arguments":{"query":"\\ud83d\\ude00 \\udc00"}}</tool_call>'),
        (5, 0, "assistant", '<tool_call>{"id":1,"name":"search","arguments":{"query":"x","limit":' + "9" * 5000 + "}}</tool_call>"),
        (6, 0, "tool", '{"id":"q","content":1e999}'),
    ]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), chat.TOOLS).collect()}
    assert got[1]["n_invalid"] == 1 and got[2]["n_calls"] == got[3]["n_calls"] == 0 and json.loads(got[2]["chat"])["messages"][0]["content"] == deep
    c = json.loads(got[4]["chat"])["messages"][0]["tool_calls"][0]
    assert (c["id"], c["arguments"]["query"]) == ("\ufffd", "😀 \ufffd")
    assert got[5]["n_calls"] == 0 and json.loads(got[6]["chat"])["messages"][0]["tool_results"] == [{"content": None, "id": "q"}]
