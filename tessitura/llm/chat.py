"""Chat formatting with linked tool calls.

A message may hold tool calls and tool results, as JSON objects between ``<tool_call>`` and ``<tool_result>`` tags, or, for
the role ``tool``, as its whole text. A call is ``{"id", "name", "arguments"}``; a result is ``{"id", "content"}``.
An argument ``{"$result": id}`` anywhere in a call's arguments stands for that call's result.

Calls and results are hash-joined by conversation, identifier and occurrence (the k-th result of an identifier
belongs to its k-th call). Calls are ordered topologically: a call comes after those whose results it uses, and else in the order of
the messages. Arguments are validated against the tools' JSON schemas. Each conversation is serialised as
canonical JSON: keys sorted, no white space, no escapes but those that JSON demands.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.llm.common import map_batches, staged, table

#: Brackets within brackets that JSON in a message may have; what nests deeper stays text.
DEEPEST = 200
TAGGED = re.compile(r"<(tool_call|tool_result)>(.*?)</\1>", re.S)
TYPES: dict[str, Any] = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """Canonical JSON. Numbers that are whole and have no exponent are written without a point; NaN and infinities are null."""

    def plain(x: Any) -> Any:
        if isinstance(x, float):
            if x != x or x in (float("inf"), float("-inf")):
                return None
            return int(x) if x.is_integer() and abs(x) < 1 << 53 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def is_type(value: Any, name: str) -> bool:
    if name in ("number", "integer"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (name == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, TYPES[name]) if name in TYPES else True


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema (type, enum, bounds, lengths, pattern, required, properties, additionalProperties, items). A reference to a result fits any."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []
    kinds = schema.get("type")
    if kinds and not any(is_type(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    if is_type(value, "number"):
        out += [f"{at}: {k} {schema[k]}" for k, bad in (("minimum", lambda m: value < m), ("maximum", lambda m: value > m)) if k in schema and bad(schema[k])]
    if isinstance(value, str):
        out += [f"{at}: {k} {schema[k]}" for k, bad in (("minLength", lambda m: len(value) < m), ("maxLength", lambda m: len(value) > m), ("pattern", lambda p: not re.search(p, value))) if k in schema and bad(schema[k])]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            more = schema.get("additionalProperties", True)
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif more is False:
                out.append(f"{at}.{k}: unknown")
            elif isinstance(more, dict):
                out += violations(value[k], more, f"{at}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def uses(value: Any) -> list[str]:
    """The identifiers of the results that arguments refer to."""
    if isinstance(value, dict):
        return [str(value["$result"])] if set(value) == {"$result"} else [u for k in sorted(value) for u in uses(value[k])]
    return [u for v in value for u in uses(v)] if isinstance(value, list) else []


def loaded(body: str) -> Any:
    """JSON with lone surrogates read as U+FFFD; ValueError if it is none, if it nests deeper than ``DEEPEST`` or if a number in it has too many digits to be read."""
    try:
        value = json.loads(body)
    except RecursionError:
        raise ValueError("nested too deep") from None
    level = [value]
    for _ in range(DEEPEST):
        level = [v for x in level if isinstance(x, dict | list) for v in (x.values() if isinstance(x, dict) else x)]
        if not level:
            break
    else:
        raise ValueError("nested too deep")

    def whole(x: Any) -> Any:
        if isinstance(x, str):
            return x.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        if isinstance(x, dict):
            return {whole(k): whole(v) for k, v in x.items()}
        return [whole(v) for v in x] if isinstance(x, list) else x

    return whole(value) if "\\u" in body else value


def parse_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str | None, list[dict], list[dict]]:
    """What is left of a message's text, its calls and its results. What can't be parsed stays in the text."""
    calls: list[dict] = []
    results: list[dict] = []

    def take(kind: str, body: str) -> bool:
        try:
            x = loaded(body)
        except ValueError:
            return False
        if not isinstance(x, dict) or x.get("id") is None or ("name" not in x if kind == "tool_call" else "content" not in x):
            return False
        if kind == "tool_result":
            results.append({"id": str(x["id"]), "content": canonical(x["content"])})
            return True
        arguments = x.get("arguments", {})
        if isinstance(arguments, str):
            try:
                arguments = loaded(arguments)
            except ValueError:
                pass
        schema = schemas.get(str(x["name"]))
        errors = ["no such tool"] if schema is None else violations(arguments, schema)
        calls.append({"id": str(x["id"]), "name": str(x["name"]), "arguments": canonical(arguments), "errors": errors, "uses": uses(arguments)})
        return True

    if text is None:
        return None, calls, results
    if role == "tool" and take("tool_result", text):
        return "", calls, results
    if "<tool_" not in text:
        return text, calls, results
    left = TAGGED.sub(lambda m: "" if take(m[1], m[2]) else m[0], text)
    return (left.strip() if calls or results else left), calls, results


def topological(calls: list[dict]) -> tuple[list[int], bool]:
    """The calls' places in an order in which each follows those whose results it uses, earlier ones first, and whether there was a cycle (its calls keep the order of the messages)."""
    places: dict[str, list[int]] = defaultdict(list)
    for i, c in enumerate(calls):
        places[c["id"]].append(i)
    after: dict[int, set[int]] = defaultdict(set)
    waits = [0] * len(calls)
    for i, c in enumerate(calls):
        for j in {places[u][0] for u in c["uses"] if u in places} - {i}:
            after[j].add(i)
            waits[i] += 1
    ready = [i for i, w in enumerate(waits) if not w]
    heapq.heapify(ready)
    out: list[int] = []
    while ready:
        i = heapq.heappop(ready)
        out.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, j)
    rest = sorted(set(range(len(calls))) - set(out))
    return out + rest, bool(rest)


def conversation_json(messages: list[dict], calls: list[dict], loose: list[dict] | None = None) -> str:
    """Canonical JSON of a conversation; ``calls`` in the order of their messages, and the ``loose`` results that belong to no call with theirs."""
    own: dict[int, dict[str, list[dict]]] = defaultdict(dict)
    for c in calls:
        own[c["seq"]].setdefault("tool_calls", []).append({"arguments": json.loads(c["arguments"]), "errors": c["errors"], "id": c["id"], "name": c["name"], "result": None if c["result"] is None else json.loads(c["result"])})
    for r in loose or ():
        own[r["seq"]].setdefault("tool_results", []).append({"content": json.loads(r["result"]), "id": r["id"]})
    order, cyclic = topological(calls)
    out: dict[str, Any] = {"messages": [{"content": m["content"], "role": m["role"], "turn": m["turn"]} | own.get(m["seq"], {}) for m in messages]}
    if calls:
        out |= {"call_order": [calls[i]["id"] for i in order], "cyclic": cyclic}
    return canonical(out)


CALL = "struct<id:string,name:string,arguments:string,errors:array<string>,uses:array<string>>"
RESULT = "struct<id:string,content:string>"


def format_chats(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_messages, n_calls, n_results, n_linked, n_invalid and ``chat``, its canonical JSON.

    ``conversations`` has conv_id, turn, role and text; ``schemas`` has a JSON schema by tool. Messages are
    ordered by turn (null first), then role and text; repeated rows are repeated messages; null conv_ids are one
    conversation; null texts have null content. Calls without a result have result null; results without a call stay
    with their message as ``tool_results``. A conversation becomes one row, as its format demands, so one task holds one conversation at a time.
    """
    schemas = schemas or {}
    turn_type = conversations.schema["turn"].dataType.simpleString()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("seq", F.row_number().over(order))
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, seq int, turn {turn_type}, role string, content string, calls array<{CALL}>, results array<{RESULT}>"
    call_type = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("errors", pa.list_(pa.string())), ("uses", pa.list_(pa.string()))]))
    result_type = pa.list_(pa.struct([("id", pa.string()), ("content", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [parse_message(r, t, schemas) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], call_type), pa.array([x[2] for x in found], result_type)],
            ["conv_id", "seq", "turn", "role", "content", "calls", "results"],
        )

    parsed = staged(map_batches(numbered.select("conv_id", "seq", "turn", "role", "text"), run, schema), "messages")
    calls = parsed.select("conv_id", "seq", F.posexplode("calls").alias("place", "c")).select("conv_id", "seq", "place", "c.*")
    results = parsed.select("conv_id", "seq", F.posexplode("results").alias("place", "r")).select("conv_id", "seq", "place", F.col("r.id").alias("id"), F.col("r.content").alias("result"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "id").orderBy("seq", "place"))
    paired = calls.withColumn("nth", nth).alias("c").join(
        results.withColumn("nth", nth).alias("r").hint("shuffle_hash"),
        F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("c.id") == F.col("r.id")) & (F.col("c.nth") == F.col("r.nth")),
        "full_outer",
    )
    # a result without a call is a row without a name
    paired = paired.select(
        F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), *(F.coalesce(f"c.{k}", f"r.{k}").alias(k) for k in ("seq", "place", "id")), "c.name", "c.arguments", "c.errors", "c.uses", "r.result"
    )
    gathered = paired.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "place", "id", "name", "arguments", "errors", "uses", "result"))).alias("calls"))
    chats = parsed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "turn", "role", "content"))).alias("messages"), F.sum(F.size("results")).alias("n_results"))
    both = chats.alias("m").join(gathered.alias("g"), F.col("m.conv_id").eqNullSafe(F.col("g.conv_id")), "left").select("m.conv_id", "m.messages", "m.n_results", "g.calls")

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for messages, n_results, own in zip(*(c.to_pylist() for c in batch.columns[1:])):
            loose = [c for c in own or () if c["name"] is None]
            own = [c for c in own or () if c["name"] is not None]
            rows.append((len(messages), len(own), n_results, sum(c["result"] is not None for c in own), sum(bool(c["errors"]) for c in own), conversation_json(messages, own, loose)))
        kinds = [pa.int64()] * 5 + [pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["conv_id", "n_messages", "n_calls", "n_results", "n_linked", "n_invalid", "chat"])

    return map_batches(both, write, f"conv_id {id_type}, n_messages bigint, n_calls bigint, n_results bigint, n_linked bigint, n_invalid bigint, chat string")


#: The tools that conversations of the query may call.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as canonical JSON."""
    return format_chats(table(spark, sf_dir, "conversations"), TOOLS)


#: The tables' conversations hold no calls, so their JSON is that of their messages.
OP5_SQL = """
SELECT conv_id, count(*) AS n_messages, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_results,
       CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid,
       '{"messages":[' || string_agg('{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || ',"turn":' || to_json(turn)::VARCHAR || '}', ',' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) || ']}' AS chat
FROM conversations GROUP BY conv_id
"""
