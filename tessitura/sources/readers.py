"""Sources: request bodies, event-stream lines, replayed fragments, dictionaries and sound files."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.arrays import wav_seconds
from tessitura.functions.rewriting import Text, col

REQUEST = "input string, voice string, model string, response_format string, temperature double, repetition_penalty double, max_tokens int, stream boolean, playback_speed double, playback_overlap_speed double, normalize_malaysian boolean"


def requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON requests, one a line, in batch or as they arrive; malformed ones give nulls."""
    return (spark.readStream if streaming else spark.read).schema(REQUEST).json(path)


def event_text(line: Text) -> Column:
    """The text of an event-stream line: null for what is no data, is the end mark or has no choice."""
    body = F.regexp_extract(col(line), r"^data: (.*)$", 1)
    parsed = F.from_json(body, "choices array<struct<text string>>")
    return F.when((body != "") & (body != "[DONE]"), F.get(parsed["choices"], 0)["text"])


def event_fragments(lines: DataFrame, line: str = "value") -> DataFrame:
    """The texts of the lines that have one."""
    return lines.withColumn("fragment", event_text(line)).where(F.col("fragment").isNotNull())


def replay(fragments: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, numbered by ``round``."""
    return fragments.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(times))))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of words or of a map as (word, value); value is null for words."""
    whole = spark.read.text(path, wholetext=True)
    as_map, as_list = F.from_json("value", "map<string,string>"), F.from_json("value", "array<string>")
    words = F.map_from_arrays(as_list, F.transform(as_list, lambda _: F.lit(None).cast("string")))
    return whole.select(F.explode(F.when(F.startswith(F.ltrim("value"), F.lit("[")), words).otherwise(as_map)).alias("word", "value"))


def inverted(table: DataFrame) -> DataFrame:
    """(value, word) of a map; of several words the greatest counts."""
    return table.where(F.col("value").isNotNull()).groupBy(F.col("value").alias("word")).agg(F.max("word").alias("value"))


def sounds(spark: SparkSession, path: str) -> DataFrame:
    """Sound files with their duration in seconds."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", wav_seconds("content").alias("seconds"))


def reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Report and manifest files: one JSON document a file, over several lines, or with ``lines`` one a line, as ``json_report`` writes them."""
    return spark.read.option("multiLine", not lines).json(path)


@dataclass(frozen=True)
class Settings:
    """What a service reads from its environment, by type; lists are JSON."""

    chunk: int = 25
    context: int = 25
    max_tokens: int = 1024
    temperature: float = 0.7
    debug: bool = False
    batch_sizes: tuple[int, ...] = (1, 2, 4, 8)

    @classmethod
    def of(cls, environment: Mapping[str, str]) -> Settings:
        """Settings named in capitals; what is not set keeps its default."""
        found = {}
        for f in fields(cls):
            text = environment.get(f.name.upper())
            if text is None:
                continue
            kind = type(f.default)
            found[f.name] = text.lower() in ("1", "true", "yes") if kind is bool else tuple(json.loads(text)) if kind is tuple else kind(text)
        return cls(**found)
