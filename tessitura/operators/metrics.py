"""Latency, throughput and error-rate metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.rewriting import Text, col, let
from tessitura.functions.text import comparison_form
from tessitura.operators.ranks import at_ranks


def bench_percentile(values: Column, p: float) -> Column:
    """The element at ``round(p / 100 * n + 0.5)``, rounded half to even, of the sorted values; null of none."""
    n = F.size(values)
    at = F.greatest(F.lit(1), F.least(n, F.bround(n * F.lit(p / 100) + F.lit(0.5), 0).cast("int")))
    return F.when(n > 0, F.get(F.array_sort(values), at - 1))


def stress_percentile(values: Column, q: float) -> Column:
    """The element at ``int(q * n)`` of the sorted values; where that is 0, the last."""
    at = F.floor(F.size(values) * F.lit(q)).cast("int")
    return F.when(F.size(values) > 0, F.try_element_at(F.array_sort(values), F.when(at == 0, -1).otherwise(at)))


def bench_rank(p: float) -> Callable[[Column], Column]:
    """The rank of ``bench_percentile`` among n values."""
    return lambda n: F.greatest(F.lit(1), F.least(n, F.bround(n * F.lit(p / 100) + F.lit(0.5), 0).cast("long")))


def stress_rank(q: float) -> Callable[[Column], Column]:
    """The rank of ``stress_percentile`` among n values."""
    return lambda n: F.when(F.floor(n * F.lit(q)) == 0, n).otherwise(F.floor(n * F.lit(q)))


def ratio(part: Text, whole: Text) -> Column:
    """``part / whole``, null unless the whole is positive."""
    return F.when(col(whole) > 0, col(part) / col(whole))


def level_report(df: DataFrame, level: str, latency: str, audio: str, wall: str) -> DataFrame:
    """Per level: requests, throughput, mean latency, percentiles of latency and of real-time factor. Percentiles by rank come from counts of slices of a level's values."""
    told = df.withColumn("__rtf", ratio(latency, audio))
    out = told.groupBy(level).agg(F.count("*").alias("n"), F.sum(audio).alias("audio_s"), F.max(wall).alias("wall_s"), F.avg(latency).alias("latency_avg"))
    slow = at_ranks(told, [level], latency, {f"latency_p{p}": bench_rank(p) for p in (50, 95, 99)})
    factor = at_ranks(told, [level], "__rtf", {"rtf_p50": bench_rank(50)})
    return out.join(slow, level, "left").join(factor, level, "left").select(
        level, "n", (F.col("n") / F.col("wall_s")).alias("requests_per_s"), (F.col("audio_s") / F.col("wall_s")).alias("audio_per_s"), "latency_avg",
        "latency_p50", "latency_p95", "latency_p99", "rtf_p50",
    )


def slo_report(df: DataFrame, level: str, latency: str, audio: str) -> DataFrame:
    """Per level what a service reports after a load test: requests, their times, seconds of sound, and the real-time factor of those that have sound.

    Medians are between the two middle values; the other percentiles are the elements at ``int(q * n) - 1`` of the sorted values (of fewer, the last).
    """
    told = df.withColumn("__rtf", ratio(latency, audio))
    out = told.groupBy(level).agg(
        F.count(latency).alias("n"), F.min(latency).alias("time_min"), F.max(latency).alias("time_max"), F.avg(latency).alias("time_avg"), F.avg(audio).alias("audio_avg"),
        F.min("__rtf").alias("rtf_min"), F.max("__rtf").alias("rtf_max"), F.avg("__rtf").alias("rtf_avg"),
    )
    middles = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor((n + 2) / 2)}
    for name, value in (("time", latency), ("rtf", "__rtf")):
        asked = {**{f"{name}_{k}": rank for k, rank in middles.items()}, **{f"{name}_p{p}": stress_rank(p / 100) for p in (90, 95, 99)}}
        found = at_ranks(told, [level], value, asked).withColumn(f"{name}_p50", (F.col(f"{name}_low") + F.col(f"{name}_high")) / 2)
        out = out.join(found.drop(f"{name}_low", f"{name}_high"), level, "left")
    figures = [f"{name}_{k}" for name in ("time", "rtf") for k in ("min", "max", "avg", "p50", "p90", "p95", "p99")]
    return out.select(level, "n", "audio_avg", *figures)


def character_error_rate(reference: Text, hypothesis: Text) -> Column:
    """Edit distance of characters over the reference's length, both in comparison form; null without a reference."""
    a, b = comparison_form(reference), comparison_form(hypothesis)
    return F.when(F.length(a) > 0, F.levenshtein(a, b) / F.length(a))


def word_error_rate(reference: Text, hypothesis: Text) -> Column:
    """Edit distance of words over the reference's words. Words become characters, one for each distinct word of both texts, from the planes above the first two (983,040 of them)."""

    def rate(both: Column) -> Column:
        a, b = both["a"], both["b"]
        coded = lambda ws, known: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0x1FFFF), 8, "0")), "UTF-32")), "")
        return let(F.array_distinct(F.concat(a, b)), lambda known: F.levenshtein(coded(a, known), coded(b, known)) / F.size(a))

    return F.when(comparison_form(reference) != "", let(F.struct(F.split(comparison_form(reference), " ").alias("a"), F.split(comparison_form(hypothesis), " ").alias("b")), rate))


def median_of_runs(df: DataFrame, keys: list[str], run: str, value: str) -> DataFrame:
    """The median over runs of each run's mean."""
    return df.groupBy(*keys, run).agg(F.avg(value).alias("__v")).groupBy(*keys).agg(F.median("__v").alias("median"), F.count("*").alias("runs"))
