"""Chunks of a stream equal those of the batch operator."""

from __future__ import annotations

import time

import pandas as pd

from pyspark.sql import functions as F

from tessitura.operators.windows import chunk_codes, chunk_sizes
from tessitura.streaming.chunks import CANCEL, END, chunk_stream, in_order, step


def test_sizes():
    assert chunk_sizes(1.5, 0.2) == (75, 10) and chunk_sizes(1.0, 0.001) == (50, 1)


def test_steps_with_cut_fragments():
    out = []
    rest, codes, k, first = "", [], 0, 0
    for f in ["<|s_1|><|s", "_2|>", "<|s_3|><|s_4|><|s_5|>", END]:
        rest, codes, k, first, more = step(rest, codes, k, first, [f], 2, 1)
        out += more
    assert out == [(0, 0, 2, [1, 2, 3]), (1, 2, 4, [2, 3, 4, 5]), (2, 4, 5, [4, 5])]


def test_stream_equals_batch(spark, tmp_path):
    n = {"a": 17, "b": 4, "c": 1}
    rows = [(r, i, f"<|s_{i}|>") for r, m in n.items() for i in range(m)] + [(r, m, END) for r, m in n.items()]
    spark.createDataFrame(rows, "request string, seq int, fragment string").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request string, seq int, fragment string").parquet(str(tmp_path / "in"))
    query = chunk_stream(stream, 4, 2).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["request"], r["k"], r["start"], r["end"], tuple(r["codes"])) for r in spark.table("chunks").collect())
    batch = spark.createDataFrame([(r, list(range(m))) for r, m in n.items()], "request string, codes array<int>")
    want = sorted((r["request"], r["k"], r["start"], r["end"], tuple(r["codes"])) for r in chunk_codes(batch, "request", "codes", 4, 2).collect())
    assert got == want


def test_empty_streams_have_no_chunks(spark):
    batch = spark.createDataFrame([("a", [])], "request string, codes array<int>")
    assert chunk_codes(batch, "request", "codes", 4, 2).count() == 0
    assert batch.select(F.size("codes")).first()[0] == 0


def test_requests_that_are_cancelled_or_never_end(spark, tmp_path):
    rows = [("gone", i, f"<|s_{i}|>") for i in range(9)] + [("gone", 9, CANCEL)] + [("open", i, f"<|s_{i}|>") for i in range(3)] + [("done", 0, "<|s_7|>"), ("done", 1, END)]
    spark.createDataFrame(rows, "request string, seq int, fragment string").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request string, seq int, fragment string").parquet(str(tmp_path / "in"))
    query = chunk_stream(stream, 4, 2, idle=1000).writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    for _ in range(60):
        time.sleep(0.5)
        got = sorted((r["request"], r["start"], r["end"]) for r in spark.table("ended").collect())
        if len(got) == 2:
            break
    query.stop()
    assert got == [("done", 0, 1), ("open", 0, 3)]


def test_rows_of_several_frames_come_in_order():
    frames = [pd.DataFrame({"seq": [3, 1], "fragment": ["c", "a"], "error": [None, "x"]}), pd.DataFrame({"seq": [2], "fragment": ["b"], "error": [None]})]
    assert in_order(iter(frames), "fragment", "error") == [["a", "b", "c"], ["x", None, None]]
