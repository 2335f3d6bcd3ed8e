"""Assembling sounds from decoded pieces: trims, alignment, overlap-add."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.arrays import SAMPLES_PER_CODE, zero_crossings
from tessitura.functions.rewriting import Text, col

MARGIN = 256


def trim_at_crossing(samples: Text, margin: int = MARGIN) -> Column:
    """Cut at the last change of sign within the final ``margin`` samples; short sounds and those without one stay."""
    s = col(samples)
    tail = F.slice(s, F.size(s) - margin + 1, F.lit(margin))
    last = F.array_max(zero_crossings(tail))
    return F.when(F.size(s) < 2 * margin, s).when(last.isNull(), s).otherwise(F.slice(s, F.lit(1), F.size(s) - margin + last - 1))


def trim_output(samples: Text, codes: Text) -> Column:
    """As many samples as the codes stand for; padding of the batch goes."""
    return F.slice(col(samples), F.lit(1), F.size(col(codes)) * SAMPLES_PER_CODE)


def aligned(a: Text, b: Text) -> Column:
    """Two arrays cut to the shorter length."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    return F.struct(F.slice(col(a), F.lit(1), n).alias("a"), F.slice(col(b), F.lit(1), n).alias("b"))


def hann(i: Column, n: int) -> Column:
    """A value of the periodic Hann window."""
    return F.lit(0.5) * (1 - F.cos(F.lit(2 * math.pi) * i / n))


def overlap_add(frames: DataFrame, key: str, number: str, samples: str, hop: int, width: int) -> DataFrame:
    """(key, at, value): windowed frames summed at their places and divided by the summed squared window, cut to "same" length.

    Samples are grouped by place, so a sound of any length is spread over tasks; sums are made before the shuffle.
    """
    rows = frames.select(key, number, F.posexplode(samples).alias("i", "x"))
    window = hann(F.col("i"), width)
    placed = rows.select(key, (F.col(number) * hop + F.col("i") - (width - hop) // 2).alias("at"), (F.col("x") * window).alias("x"), (window * window).alias("w"))
    ends = frames.groupBy(key).agg(((F.max(number) + 1) * hop).alias("__n"))
    summed = placed.where("at >= 0").groupBy(key, "at").agg(F.sum("x").alias("x"), F.sum("w").alias("w")).where("w > 1e-11")
    return summed.join(ends, key).where("at < __n").select(key, "at", (F.col("x") / F.col("w")).alias("value"))
