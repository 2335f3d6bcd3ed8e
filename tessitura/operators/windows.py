"""Chunks of token streams with context on both sides, in batch, and simulated micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CODES_PER_SECOND = 50


def chunk_sizes(speed: float, overlap: float, rate: int = CODES_PER_SECOND) -> tuple[int, int]:
    """Codes of a chunk and of its context for a playback speed and overlap in seconds."""
    return int(speed * rate), max(1, int(overlap * rate))


def chunk_bounds(streams: DataFrame, key: str, n: str, chunk: int, context: int) -> DataFrame:
    """One row per chunk of each stream: number, first and last code (exclusive), and the range with context.

    A chunk is emitted when it and its context have arrived. The end of the stream flushes what is left as one chunk.
    """
    whole = F.floor((F.greatest(F.col(n) - context, F.lit(0))) / F.lit(chunk)).cast("int")
    rest = F.when(whole * chunk < F.col(n), 1).otherwise(0)
    rows = streams.select(key, n, whole.alias("__whole"), F.explode(F.when(whole + rest > 0, F.sequence(F.lit(0), whole + rest - 1))).alias("k"))
    start = F.col("k") * chunk
    end = F.when(F.col("k") < F.col("__whole"), start + chunk).otherwise(F.col(n))
    return rows.select(key, "k", start.alias("start"), end.alias("end"), F.greatest(start - context, F.lit(0)).alias("from"), F.least(end + context, F.col(n)).alias("to"))


def chunk_codes(streams: DataFrame, key: str, codes: str, chunk: int, context: int) -> DataFrame:
    """The codes of every chunk with its context."""
    sized = streams.withColumn("__n", F.size(codes))
    bounds = chunk_bounds(sized, key, "__n", chunk, context)
    return bounds.join(streams.select(key, codes), key).withColumn("codes", F.slice(codes, F.col("from") + 1, F.col("to") - F.col("from")))


def micro_batches(events: DataFrame, time: str, wait_ms: int, most: int, *order: str) -> DataFrame:
    """``slot`` and ``batch``: what arrives within ``wait_ms`` forms batches of at most ``most`` in order, nulls last.

    Slots are whole quotients as SQL's integer division has them, so that those before 1970 are counted towards it.
    """
    at = F.unix_millis(F.col(time).cast("timestamp"))
    kind = dict(events.dtypes)[time]
    if kind in ("timestamp_ntz", "date"):  # times without a zone count from the epoch as they are written, whatever the session's zone
        at = F.unix_date(F.to_date(time)).cast("long") * 86_400_000
        if kind == "timestamp_ntz":
            at = at + F.hour(time) * 3_600_000 + F.minute(time) * 60_000 + F.date_format(time, "s").cast("long") * 1000 + F.date_format(time, "SSS").cast("long")
    slot = ((at - at % F.lit(wait_ms)) / F.lit(wait_ms)).cast("long")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(*(F.col(c).asc_nulls_last() for c in (time, *order))))
    return events.withColumn("slot", slot).withColumn("batch", F.floor((rank - 1) / F.lit(most)).cast("long"))


def trailing_windows(streams: DataFrame, key: str, codes: str, chunk: int) -> DataFrame:
    """The last ``chunk`` codes each time their number reaches a multiple of ``chunk``."""
    whole = F.floor(F.size(codes) / F.lit(chunk)).cast("int")
    rows = streams.select(key, codes, F.explode(F.when(whole > 0, F.sequence(F.lit(1), whole))).alias("__k"))
    return rows.select(key, (F.col("__k") * chunk).alias("seen"), F.slice(codes, (F.col("__k") - 1) * chunk + 1, F.lit(chunk)).alias("codes"))
