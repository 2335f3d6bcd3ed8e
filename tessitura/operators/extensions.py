"""Where callers plug in models: spellers, stemmers, translators, scorers, segmenters, codecs.

Each is a plain function over a batch of values. It is wrapped as an Arrow UDF, so it sees columns, not
rows, and a model that it loads is loaded once for each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_function(function: Callable[[pd.Series], pd.Series], returns: str = "string") -> Callable[[Column], Column]:
    """A function of a series as a function of a column."""

    def run(values: pd.Series) -> pd.Series:
        return function(values)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)


def with_model(df: DataFrame, load: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a model to Arrow batches; ``load`` runs once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInArrow(run, schema)


def stub_codec(codes_per_second: int = 50, samples_per_code: int = 480) -> Callable[[Column], Column]:
    """A stand-in for a neural decoder: each code becomes that many equal samples. It keeps the dataflow around it testable."""
    return lambda codes: F.flatten(F.transform(codes, lambda c: F.array_repeat((c.cast("double") / 32768 - 1), samples_per_code)))
