"""Load simulation and reports: job pools, errors, manifests and error rates by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.operators.metrics import character_error_rate, word_error_rate
from tessitura.operators.ranks import numbered


def samples_of(items: DataFrame, times: int) -> DataFrame:
    """Every item ``times`` times with ``k``, the number of the sample."""
    return items.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def dealt(jobs: DataFrame, workers: int, *order: str) -> DataFrame:
    """``worker``: jobs dealt in turn, the last one first, as from a shared list. Within the hash of a job each worker's share is equal on average."""
    return jobs.withColumn("worker", F.pmod(F.xxhash64(*order), F.lit(workers)).cast("int"))


def errors(df: DataFrame, group: str, message: str, order: str, shown: int = 3) -> DataFrame:
    """Per group how many failed, and the first messages in order. The first ones of each of 64 parts of a group are found before those of the group."""
    failed = df.where(F.col(message).isNotNull()).withColumn("__part", F.pmod(F.xxhash64(order), F.lit(64)))
    in_part = F.row_number().over(Window.partitionBy(group, "__part").orderBy(order))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = failed.withColumn("__r", in_part).where(F.col("__r") <= shown).withColumn("__r", rank).where(F.col("__r") <= shown)
    sample = first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", message))), lambda s: s[message]), "|").alias("sample"))
    return failed.groupBy(group).agg(F.count("*").alias("errors")).join(sample, group)


def joined_transcripts(manifest: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Manifest rows with their transcripts and error rates, by item and sample."""
    both = manifest.join(transcripts, ["id", "k"])
    return both.withColumn("cer", character_error_rate("text", "hyp")).withColumn("wer", word_error_rate("text", "hyp"))


def in_manifest_order(rows: DataFrame) -> DataFrame:
    """Rows by item and sample."""
    return rows.orderBy("id", "k")


def answered(requests: DataFrame, results: DataFrame, on: str = "request") -> DataFrame:
    """Every request with its result; those without one keep nulls."""
    return requests.join(results, on, "left")


def error_rates_by_group(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Mean error rates by what stands before the first underscore of the id."""
    return rows.groupBy(F.substring_index(id_col, "_", 1).alias("group")).agg(F.count("*").alias("n"), F.round(F.avg("cer"), 4).alias("cer"), F.round(F.avg("wer"), 4).alias("wer"))


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values in order: (keys, value, first, length). Gaps and islands by window functions."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(w))
    return numbered.groupBy(*keys, "__run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.count("*").alias("length")).drop("__run")


def in_turn(jobs: DataFrame, level: str, workers: int, order: str) -> DataFrame:
    """``worker``: the jobs of each level dealt one by one to its workers, in the order of a numeric column."""
    return numbered(jobs, [level], order).withColumn("worker", ((F.col("rank") - 1) % workers).cast("long")).drop("rank")
