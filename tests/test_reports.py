"""Reports, ranks of equal values, words inside words, and the evaluation set."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessitura.functions import numbers
from tessitura.operators import lexicon, metrics, ranks, reports
from tessitura.sources import writers
from tessitura.sources.evaluation import evaluation_set


def test_slo_report_and_its_lines(spark):
    rng = random.Random(1)
    rows = [(level, round(rng.uniform(0.1, 9), 3), rng.choice([0.0, 1.5, 4.0])) for level in (1, 8) for _ in range(rng.randint(3, 60))] + [(2, 5.0, 2.0), (3, 1.0, 0.0)]
    report = metrics.slo_report(spark.createDataFrame(rows, "level int, t double, a double"), "level", "t", "a")
    got = {r["level"]: r.asDict() for r in report.collect()}
    for level in (1, 2, 3, 8):
        times = sorted(t for k, t, _ in rows if k == level)
        factors = sorted(t / a for k, t, a in rows if k == level and a > 0)
        for name, values in (("time", times), ("rtf", factors)):
            want = [min(values), max(values), sum(values) / len(values), statistics.median(values), *(values[int(q * len(values)) - 1] for q in (0.9, 0.95, 0.99))] if values else [None] * 7
            assert [got[level][f"{name}_{k}"] for k in ("min", "max", "avg", "p50", "p90", "p95", "p99")] == pytest.approx(want) if values else want
    lines = [r["line"] for r in writers.slo_lines(report.where("level = 2"), "level").orderBy("at").collect()]
    assert lines[0] == "Total Requests: 1" and lines[1] == "Min Time: 5.000s" and lines[8] == "Avg Audio Duration: 2.000s" and lines[12] == "P50 RTF: 2.500" and len(lines) == 16
    assert writers.slo_lines(report.where("level = 3"), "level").count() == 9


def test_equal_values_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SLICES", 4)
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([5.0] * 5 + [1.0, 2.0, 9.0])) for i in range(600)]
    got = ranks.numbered(spark.createDataFrame(rows, "i int, g string, v double"), ["g"], "v").collect()
    for g in "ab":
        own = sorted((r["rank"], r["v"]) for r in got if r["g"] == g)
        assert [r for r, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for _, v in own)
    assert sorted(r["i"] for r in got) == list(range(600)) and set(got[0].asDict()) == {"i", "g", "v", "rank"}


@pytest.mark.parametrize("short", [2, 24])
def test_words_inside_words(spark, monkeypatch, short):
    monkeypatch.setattr(lexicon, "SHORT", short)
    rng = random.Random(3)
    found = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["abc" * 12, "xabc" + "abc" * 12, "q" * 40, "q" * 41, "z" * 30]
    got = sorted(r[0] for r in lexicon.keep_longest(spark.createDataFrame([(w,) for w in [*found, *found, "", None]], "word string")).collect())
    assert got == sorted({w for w in found if not any(w in x and w != x for x in found)})
    assert [r[0] for r in lexicon.keep_longest(spark.createDataFrame([("",)], "word string")).collect()] == [""]


def test_a_very_long_word(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(10_000))
    found = [long, long[500:540], long[100:104], "zz", long[9_000:] + "!"]
    assert sorted(r[0] for r in lexicon.keep_longest(spark.createDataFrame([(w,) for w in found], "word string")).collect()) == sorted([long, "zz", long[9_000:] + "!"])


def test_evaluation_set(spark):
    items = evaluation_set(spark)
    assert items.count() == 16 and items.select("id").distinct().count() == 16
    manifest = reports.samples_of(items, 2)
    joined = reports.joined_transcripts(manifest, manifest.select("id", "k", F.when(F.col("k") == 0, F.col("text")).otherwise("").alias("hyp")))
    rates = {r["group"]: (r["n"], r["cer"], r["wer"]) for r in reports.error_rates_by_group(joined).collect()}
    assert rates == {"en": (16, 0.5, 0.5), "ms": (12, 0.5, 0.5), "cs": (4, 0.5, 0.5)}
    assert spark.range(1).select(numbers.currency_words(F.lit("105")).alias("s")).first()["s"] == "seratus lima ringgit"
