"""Helpers shared by the training-data operators: table access, durable staging and Arrow batches."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a local one for a local session (tests) and an error for a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not context.isLocal():
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "tessitura-checkpoints"))
        found = context.getCheckpointDir().get()
    return found.rstrip("/")


#: Folders written inside each ``scratch`` block that is open, the innermost last.
OPEN: list[list[str]] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for block in OPEN[-1:]:
        block.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def unstaged(*tables: DataFrame) -> None:
    """Remove the folders of staged tables that nothing reads any more."""
    for df in tables:
        removed(df.sparkSession, df.staged_at)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is staged inside the block is removed at its end, but for paths that are taken off the list."""
    OPEN.append([])
    try:
        yield OPEN[-1]
    finally:
        for path in OPEN.pop():
            removed(spark, path)


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, staged; whatever else was staged on the way is removed."""
    with scratch(spark) as folders:
        out = staged(make(), label)
        folders.remove(out.staged_at)
    for block in OPEN[-1:]:
        block.append(out.staged_at)
    return out


def bit_map(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """The map of ``2 ** bits`` bits (6 at least) with the bits of all numbers in column ``key``, of fixed size whatever their count."""
    bit = F.shiftrightunsigned(key, 64 - bits)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = df.groupBy(F.shiftrightunsigned(bit, 6).alias("word")).agg(F.bit_or(mask).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def has_bits(words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the map has the bits of 64-bit numbers."""
    at = numbers.view(np.uint64) >> np.uint64(64 - (len(words).bit_length() + 5))
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int | None = 1024) -> DataFrame:
    """Apply ``function`` to Arrow batches of at most ``rows`` rows (None: as Spark cuts them); where it returns None there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = rows or max(batch.num_rows, 1)
            for start in range(0, batch.num_rows, size):
                out = function(batch.slice(start, size))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    """The UTF-8 bytes of a text, none for null."""
    return (text or "").encode("utf-8", "surrogatepass")


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a string or binary column as UTF-8 bytes, without decoding them in Python."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
