"""Ranks within groups of any size: a group's values are cut into slices, so that no task has to hold or sort all of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from tessitura.operators.lexicon import small

SLICES = 128
#: Parts into which rows of one value are cut while they are numbered.
TIES = 64


def sliced(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``slice``: the number of the part of its group that a numeric value falls into. Parts are of about equal size; equal values share one, and rows without a value go."""
    df = df.where(F.col(value).isNotNull())
    cuts = F.percentile_approx(value, F.array(*(F.lit(i / SLICES) for i in range(1, SLICES))), F.lit(1000))
    bounds = df.groupBy(*keys).agg(cuts.alias("__cuts"))
    return df.join(small(bounds, 10_000), keys).withColumn("slice", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


def starts(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Per group and slice: its size, ``before`` (how many rows are in the slices before) and ``total``. Groups have at most ``SLICES`` slices."""
    sizes = counts.groupBy(*keys, "slice").agg(F.sum(n).alias("size"))
    of_group = Window.partitionBy(*keys)
    upto = F.sum("size").over(of_group.orderBy("slice"))
    return sizes.withColumn("before", upto - F.col("size")).withColumn("total", F.sum("size").over(of_group))


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The values at exact ranks: ``ranks`` gives, by the name of the result, a rank (from 1) for the number of a group's values."""
    counts = sliced(df.select(*keys, value), keys, value).groupBy(*keys, "slice", value).agg(F.count("*").alias("n"))
    asked = F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("total")).cast("long").alias("rank")) for name, rank in ranks.items()))
    wanted = starts(counts, keys).select(*keys, "slice", "before", "size", F.explode(asked).alias("w"))
    wanted = wanted.where((F.col("w.rank") > F.col("before")) & (F.col("w.rank") <= F.col("before") + F.col("size"))).select(*keys, "slice", "before", "w.name", "w.rank")
    within = Window.partitionBy(*keys, "slice", "name").orderBy(value)
    found = counts.join(wanted, [*keys, "slice"]).withColumn("upto", F.col("before") + F.sum("n").over(within))
    found = found.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in ranks))


def numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rank`` (from 1): the row's place in its group by a numeric column; of equal ones any comes first.

    Equal values are cut into ``TIES`` parts by a hash of the row, so that no task holds all rows of one value either.
    """
    own = F.pmod(F.xxhash64(*(F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, MapType))), F.lit(TIES)).cast("int")
    parts = sliced(df, keys, order).withColumn("__part", own)
    counts = parts.groupBy(*keys, "slice", order, "__part").agg(F.count("*").alias("n"))
    before = starts(counts.drop("before"), keys).select(*keys, "slice", "before")
    upto = F.sum("n").over(Window.partitionBy(*keys, "slice").orderBy(order, "__part")) - F.col("n")
    placed = counts.join(before, [*keys, "slice"]).select(*keys, order, "__part", (F.col("before") + upto).alias("__before"))
    within = Window.partitionBy(*keys, order, "__part").orderBy(order)
    return parts.drop("slice").withColumn("__r", F.row_number().over(within)).join(placed, [*keys, order, "__part"]).withColumn("rank", F.col("__before") + F.col("__r")).drop("__r", "__before", "__part")
