"""Sources, sinks, lexicons and extension points."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from tessitura.operators import extensions, lexicon, tokens
from tessitura.sources import readers, writers


def test_event_lines(spark):
    lines = ['data: {"choices":[{"text":"<|s_1|>"}]}', "data: [DONE]", "data: {broken", "", ": ping", 'data: {"choices":[]}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r["fragment"] for r in readers.event_fragments(df).collect()] == ["<|s_1|>"]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps(["a", "b"]))
    (tmp_path / "map.json").write_text(json.dumps({"x": "1", "y": "1"}))
    assert sorted(r["word"] for r in readers.dictionary(spark, str(tmp_path / "list.json")).collect()) == ["a", "b"]
    table = readers.dictionary(spark, str(tmp_path / "map.json"))
    assert [tuple(r) for r in readers.inverted(table).collect()] == [("1", "y")]


def test_requests_and_sounds(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"input": "hi", "stream": true}\nbroken\n')
    assert readers.requests(spark, str(tmp_path / "r.json")).where("input = 'hi'").count() == 1
    samples = spark.createDataFrame([([0.5] * 24,)], "s array<double>")
    (tmp_path / "a.wav").write_bytes(bytes(samples.select(writers.encoded("s")).first()[0]))
    assert readers.sounds(spark, str(tmp_path / "a.wav")).first()["seconds"] == 0.001
    assert readers.replay(samples, 3).count() == 3


def test_lexicon_joins(spark):
    words = spark.createDataFrame([("cats",), ("dog",), ("sun",), (None,)], "word string")
    entries = spark.createDataFrame([("cat",), ("dog",), ("dog",)], "word string")
    assert sorted(r["word"] for r in lexicon.members(words, entries, plural=True).collect()) == ["cats", "dog"]
    assert sorted(str(r["word"]) for r in lexicon.strangers(words, entries).collect()) == ["None", "cats", "sun"]
    table = spark.createDataFrame([("dog", "hound")], "word string, value string")
    assert sorted(str(r["rewritten"]) for r in lexicon.rewrite(words, table).collect()) == ["None", "cats", "hound", "sun"]
    assert sorted(r["word"] for r in lexicon.keep_longest(spark.createDataFrame([("an",), ("banana",), ("x",)], "word string")).collect()) == ["banana", "x"]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "harga RM5.50, hubungi 012-3456789 a@b.com #tag 3kg!")], "id int, t string")
    rows = tokens.token_rows(df, "t", "id").withColumn("kind", tokens.token_kind("token")).orderBy("pos").collect()
    assert [(r["token"], r["kind"]) for r in rows] == [
        ("harga", "word"), ("RM5.50", "money"), (",", "other"), ("hubungi", "word"), ("012-3456789", "phone"), ("a@b.com", "email"), ("#tag", "hashtag"), ("3kg", "weight"), ("!", "other"),
    ]
    assert tokens.with_lookahead(tokens.token_rows(df, "t", "id"), "id").orderBy("pos").first()["next1"] == "RM5.50"


def test_extension_points(spark):
    shout = extensions.batch_function(lambda s: pd.Series([x.upper() for x in s]))
    df = spark.createDataFrame([("a",), ("b",)], "w string")
    assert [r[0] for r in df.select(shout(F.col("w"))).collect()] == ["A", "B"]
    assert extensions.with_model(df, lambda: lambda batch: batch, "w string").count() == 2
    codec = extensions.stub_codec(samples_per_code=2)
    assert spark.createDataFrame([([0, 32768],)], "c array<int>").select(codec(F.col("c"))).first()[0] == [-1.0, -1.0, 0.0, 0.0]


def test_reports_round_trip_and_settings(spark, tmp_path):
    report = spark.createDataFrame([(1, 2.5), (2, None)], "level int, latency double")
    writers.json_report(report, str(tmp_path / "report"))
    assert sorted(map(str, readers.reports(spark, str(tmp_path / "report")).select("level", "latency").collect())) == sorted(map(str, report.collect()))
    found = readers.Settings.of({"CHUNK": "7", "TEMPERATURE": "0.5", "DEBUG": "true", "BATCH_SIZES": "[1, 3]", "OTHER": "x"})
    assert (found.chunk, found.context, found.temperature, found.debug, found.batch_sizes) == (7, 25, 0.5, True, (1, 3))


def test_error_rates_of_many_words(spark):
    from tessitura.operators import metrics

    words = [f"w{i}" for i in range(9000)]
    df = spark.createDataFrame([(" ".join(words), " ".join([*words[:8192], "other", *words[8193:]])), ("a b", "a b"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(metrics.word_error_rate("a", "b")).collect()] == [1 / 9000, 0.0, None]


def test_ranks_equal_sorted_values(spark):
    from pyspark.sql import functions as F

    from tessitura.operators import metrics, ranks

    rows = [(k, float((i * 7919) % 1000) if i % 11 else None) for k, n in (("a", 5000), ("b", 1), ("c", 3)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {r["k"]: (r["x"], r["y"]) for r in df.groupBy("k").agg(F.collect_list("v").alias("v")).select("k", metrics.bench_percentile(F.col("v"), 95).alias("x"), metrics.stress_percentile(F.col("v"), 0.95).alias("y")).collect()}
    assert {r["k"]: (r["x"], r["y"]) for r in ranks.at_ranks(df, ["k"], "v", {"x": metrics.bench_rank(95), "y": metrics.stress_rank(0.95)}).collect()} == want
