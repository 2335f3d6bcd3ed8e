"""Sinks: WAV and PCM bytes, JSON reports and console lines."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.arrays import pcm16, pcm_bytes, wav


def encoded(samples: str, response_format: str = "wav") -> Column:
    """A column of samples as bytes of a WAV file or of raw PCM."""
    values = pcm16(samples)
    return wav(values) if response_format == "wav" else pcm_bytes(values)


def response(column: str) -> Column:
    """The JSON of a normalisation response."""
    return F.to_json(F.struct(F.col(column).alias("output")))


def report_lines(report: DataFrame, level: str) -> DataFrame:
    """One line of text per level of a report."""
    return report.select(F.format_string("level=%s n=%d latency_avg=%.3f", F.col(level).cast("string"), "n", "latency_avg").alias("line"))


def slo_lines(report: DataFrame, level: str) -> DataFrame:
    """The lines of a service's report, some per level: (level, at, line), ``at`` the place of a line."""
    told = [("Total Requests: %d", "n")]
    told += [(f"{label}: %.3fs", f"time_{k}") for label, k in (("Min Time", "min"), ("Max Time", "max"), ("Avg Time", "avg"), ("P50 (Median)", "p50"), ("P90", "p90"), ("P95", "p95"), ("P99", "p99"))]
    told += [("Avg Audio Duration: %.3fs", "audio_avg")]
    told += [(f"{label} RTF: %.3f", f"rtf_{k}") for label, k in (("Min", "min"), ("Max", "max"), ("Avg", "avg"), ("P50", "p50"), ("P90", "p90"), ("P95", "p95"), ("P99", "p99"))]
    lines = F.array(*(F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c))) for form, c in told))
    return report.select(level, F.posexplode(lines).alias("at", "line")).where(F.col("line").isNotNull())


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a local one for a local session and an error for a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "tessitura-streams")).rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, and not again when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_to(stream: DataFrame, path: str, checkpoint: str, debug: Callable[[DataFrame, int], None] | None = None):
    """Write a stream's batches as Parquet until its input is exhausted; ``debug`` sees each batch. A batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if debug:
            debug(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def json_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines, one per level."""
    report.write.mode("overwrite").json(path)
