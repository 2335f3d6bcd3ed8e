"""Queries with models: stated functions stand for segmenters, stemmers and translators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import words
from tessitura.plans import models
from tessitura.plans.queries import query, read


def halves(found: list[str]) -> list[str]:
    """A segmenter: words of over eight letters are two."""
    return [w if len(w) <= 8 else f"{w[: len(w) // 2]} {w[len(w) // 2 :]}" for w in found]


def beginnings(found: list[str]) -> list[str]:
    """A stemmer: words of over four letters lose two."""
    return [w if len(w) <= 4 else w[:-2] for w in found]


def bracketed(found: list[str]) -> list[str]:
    """A translator: it marks what it is asked."""
    return [f"<{p}>" for p in found]


SHORT_ENDINGS = " ".join(f"WHEN '{k}' THEN '{'lah' if v in words.PARTICLES else v}'" for k, v in {**words.ENDINGS, "la": "la"}.items() if len(k) == 2)


@query(
    "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{3,}')) AS word FROM conversations), "
    "p AS (SELECT word, CASE WHEN length(word) <= 8 THEN [word] ELSE [left(word, length(word) // 2), substr(word, length(word) // 2 + 1)] END AS pieces FROM w), "
    f"r AS (SELECT word, list_transform(pieces, lambda x: CASE WHEN length(x) <= 4 OR ends_with(x, 'adalah') OR ends_with(x, 'allah') THEN x || '+' ELSE left(x, length(x) - 2) || '+' || CASE right(x, 2) {SHORT_ENDINGS} ELSE right(x, 2) END END) AS reading FROM p) "
    "SELECT word, array_to_string(reading, ' ') AS reading FROM r"
)
def word_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different word of all conversations, cut by a segmenter and a stemmer that are asked for it once."""
    found = read(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).distinct()
    told = models.word_readings(found, segment=halves, stem=beginnings)
    return told.select("word", F.array_join(F.transform("reading", lambda p: F.concat(p["stem"], F.lit("+"), p["ending"])), " ").alias("reading"))


SOUNDS = "|".join(words.LAUGHS + words.SIGHS)


@query(
    "WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM conversations), "
    "u AS (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM t), "
    f"h AS (SELECT *, CASE WHEN length(w) <= 2 THEN 'EN' WHEN length(w) = 3 THEN 'NOT_LANG' ELSE 'MS' END AS label, length(w) <= 3 AND NOT (regexp_matches(w, '^[#@]') OR (upper(w) = w AND lower(w) <> w) OR regexp_matches(lower(w), '{SOUNDS}')) AS held FROM u), "
    "g AS (SELECT *, sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM h), "
    "r AS (SELECT conv_id, turn, n, held, min(i) AS i, string_agg(w, ' ' ORDER BY i) AS phrase, bool_or(held AND label = 'EN') AS is_foreign FROM g GROUP BY ALL) "
    "SELECT conv_id, turn, string_agg(CASE WHEN is_foreign THEN '<' || phrase || '>' ELSE phrase END, ' ' ORDER BY i) AS said FROM r GROUP BY conv_id, turn"
)
def translated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of short words in conversations translated as one phrase each; the words' lengths stand for what a language model says."""
    label = lambda w: F.transform(w, lambda x: F.when(F.length(x) <= 2, "EN").when(F.length(x) == 3, "NOT_LANG").otherwise("MS"))
    turns = read(spark, sf_dir, "conversations").where(r"text rlike '\\S'").select("conv_id", "turn", F.struct("conv_id", "turn").alias("key"), F.col("text").alias("said"))
    return models.translate_runs(turns, "said", "key", label, bracketed).select("conv_id", "turn", "said")
