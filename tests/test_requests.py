"""Requests that fail, fall silent, are cancelled or go on after a restart."""

from __future__ import annotations

import random
import time

import numpy as np
from tessitura.streaming.chunks import CANCEL, END, step
from tessitura.streaming.requests import cut_at_crossing, request_chunks, request_sounds, streaming_session, windows

SCHEMA = "request string, seq int, fragment string, error string"


def run(spark, tmp_path, build, batches, name, trigger=None, until=None):
    """Rows that a stream gives for batches of rows, each put down and worked off by a new start from the same checkpoint."""
    own = streaming_session(spark)
    for n, rows in enumerate(batches):
        own.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = build(own.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))
        if trigger and n == len(batches) - 1:
            query = writer.trigger(processingTime=trigger).start()
            for _ in range(80):
                time.sleep(0.5)
                if (tmp_path / "out").exists() and until(own.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()):
                    break
            query.stop()
        else:
            writer.trigger(availableNow=True).start().awaitTermination()
    return own.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def code(i):
    return f"<|s_{i}|>"


def test_errors_cancels_and_restarts(spark, tmp_path):
    def batch(k):
        rows = [("good", i, code(i), None) for i in range(k * 7, k * 7 + 7)] + [("cut", 2 * i + k * 20, code(i)[:4], None) for i in range(3)] + [("cut", 2 * i + 1 + k * 20, code(i)[4:], None) for i in range(3)]
        if k == 0:
            rows += [("bad", i, code(i), None) for i in range(9)] + [("bad", 9, None, "backend: 500"), ("bad", 10, code(5), None)]
            rows += [("gone", i, code(i), None) for i in range(7)] + [("gone", 7, CANCEL, None), ("gone", 8, code(8), None)] + [("early", 0, None, "refused")]
        if k == 2:
            rows += [("good", 99, END, None), ("good", 100, code(1), None)]
        random.Random(k).shuffle(rows)
        return rows

    got = run(spark, tmp_path, lambda s: request_chunks(s, 4, 2), [batch(0), batch(1), batch(2)], "restarts")
    chunks = {}
    for r in got:
        chunks.setdefault(r["request"], []).append((r["k"], r["start"], r["end"], r["codes"], r["error"]))
    want = step("", [], 0, 0, [code(i) for i in range(21)] + [END], 4, 2)[4]
    assert sorted(chunks["good"]) == [(*w, None) for w in want]
    assert sorted(chunks["bad"], key=str) == [(0, 0, 4, [0, 1, 2, 3, 4, 5], None), (None, None, None, None, "backend: 500")]
    assert chunks["gone"] == [(0, 0, 4, [0, 1, 2, 3, 4, 5], None)] and chunks["early"] == [(None, None, None, None, "refused")]
    assert sorted(chunks["cut"]) == [(0, 0, 4, [0, 1, 2, 0, 1, 2], None)]


def test_silence_is_an_error_and_ended_requests_are_forgotten(spark, tmp_path):
    rows = [("silent", 0, code(1), None), ("done", 0, code(2), None), ("done", 1, END, None)]
    got = run(spark, tmp_path, lambda s: request_chunks(s, 4, 2, idle=1500), [rows], "silence", "500 milliseconds", lambda r: any(x["error"] for x in r))
    assert sorted((r["request"], r["start"], r["end"], r["error"]) for r in got) == [("done", 0, 1, None), ("silent", None, None, "no fragment for 1500 ms")]


def decoder():
    """40 samples a code, of a phase that the code names, so that signs change; made here, so that it is sent to workers by value."""

    def decode(codes):
        return np.concatenate([np.sin(0.3 * np.arange(40) + c) for c in codes]) if codes else np.zeros(0)

    return decode


decode = decoder()


def plain_windows(codes, chunk, context):
    """Windows by the definition, over the whole list of codes: buffers of fragments, decoded again and again."""
    buffer, at, left, out = [], 0, np.zeros(0, np.float32), []
    for c in codes:
        buffer.append(c)
        if len(buffer) % chunk == 0:
            y = decode(buffer)
            both = np.concatenate((left, np.clip(y[at : len(y) - context * 40], -1, 1).astype(np.float32)))
            cut = cut_at_crossing(both)
            out.append(both[:cut])
            left = both[cut:]
            if at == 0:
                at = len(y) - context * 40
            buffer = buffer[-chunk:]
    if buffer:
        out.append(np.concatenate((left, np.clip(decode(buffer)[at:], -1, 1).astype(np.float32))))
    return out


def test_windows_equal_the_definition():
    rng = random.Random(4)
    for _ in range(40):
        codes, chunk = [rng.randrange(100) for _ in range(rng.randint(0, 90))], rng.choice([5, 10, 20])
        context = rng.randint(1, chunk - 1)
        text = "".join(map(code, codes))
        held, rest, k, first, left, got = [], "", 0, 0, np.zeros(0, np.float32), []
        cuts = sorted(rng.randint(0, len(text)) for _ in range(6))
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            held, rest, k, first, left, more = windows([text[a:b]], held, rest, k, first, left, chunk, context, decode)
            got += more
            assert len(held) <= 2 * chunk
        got += windows([END], held, rest, k, first, left, chunk, context, decode)[5]
        want = plain_windows(codes, chunk, context)
        assert len(got) == len(want) and all(np.array_equal(np.array(g[3], np.float32), w) for g, w in zip(got, want))


def test_sounds_go_on_after_a_restart(spark, tmp_path):
    codes = [7 * i % 50 for i in range(43)]
    batches = [[("a", i, code(codes[i]), None) for i in range(20)], [("a", i, code(codes[i]), None) for i in range(20, 43)] + [("a", 43, END, None), ("b", 0, code(3), None), ("b", 1, None, "refused")]]
    got = run(spark, tmp_path, lambda s: request_sounds(s, 10, 3, decoder()), batches, "sounds")
    ours = sorted((r["k"], r["samples"]) for r in got if r["request"] == "a")
    want = plain_windows(codes, 10, 3)
    assert len(ours) == len(want) and all(np.array_equal(np.array(s, np.float32), w) for (_, s), w in zip(ours, want))
    assert [r["error"] for r in got if r["request"] == "b"] == ["refused"]


def test_a_request_of_chunks_costs_no_messages(spark):
    """Its state comes and goes with its fragments; calls of the state for each request were most of the time."""
    own = streaming_session(spark)
    stream = own.readStream.format("rate").load().selectExpr("CAST(value AS STRING) AS request", "1 AS seq", "'' AS fragment", "CAST(NULL AS STRING) AS error")
    plan = request_chunks(stream, 4, 2)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
