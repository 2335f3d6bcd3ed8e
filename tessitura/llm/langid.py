"""Language identification by rank-order profiles.

A profile is a language's most frequent n-grams of letters in the order of their counts. A document's own
most frequent n-grams are compared with each profile by *out-of-place distance*: the sum over its n-grams of
how far their ranks differ, with a fixed penalty for those that the profile lacks. The nearest profile wins.

N-grams are runs of one to three letters, with a blank at the start or the end of a word. A text becomes an
array of code points, lower-cased and with all but letters as blanks, and its n-grams an array of 63-bit
numbers; nothing is done per character in Python.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.llm.common import map_batches, table

#: N-grams in a profile, of a language and of a document.
PROFILE = 400
UNKNOWN = "und"
BLANK = 32
#: Code points of a text that are looked at together.
AT_ONCE = 1 << 18
_lowered: np.ndarray | None = None


def lowered() -> np.ndarray:
    """For every code point its lower case if it is a letter, else a blank."""
    global _lowered
    if _lowered is None:
        out = np.full(sys.maxunicode + 1, BLANK, np.int64)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                out[i] = ord(c.lower()[0])
        _lowered = out
    return _lowered


def slices(text: str | None) -> Iterator[np.ndarray]:
    """The text's code points, lower-cased and with blanks for all but letters, in slices of bounded size; a blank comes last."""
    text = text or ""
    for start in range(0, len(text) + 1, AT_ONCE):
        points = np.frombuffer(text[start : start + AT_ONCE].encode("utf-32-le", "surrogatepass"), np.uint32)
        low = lowered()[points]
        yield np.append(low, BLANK) if start + AT_ONCE > len(text) else low


def ngrams(parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Slice by slice all n-grams of one to three characters but those with a blank inside or alone."""
    before = np.array([BLANK], np.int64)
    for part in parts:
        low = np.concatenate((before, part))
        blank = low == BLANK
        low = low[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
        blank, known = low == BLANK, min(len(before), len(low))
        one, two, three = low[known:], low[:-1] << 21 | low[1:], low[:-2] << 42 | low[1:-1] << 21 | low[2:]
        yield np.concatenate((one[~blank[known:]], two[known - 1 :], three[~blank[1:-1]]))
        before = low[-2:]


def counted(parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, sorted, and how often each occurs; what is counted is merged whenever it has grown."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate(held), return_counts=True)
        if not len(grams):
            return new, n
        both, at = np.unique(np.concatenate((grams, new)), return_inverse=True)
        return both, np.bincount(at, np.concatenate((counts, n))).astype(np.int64)

    for part in parts:
        held.append(part)
        if sum(map(len, held)) > 3 * AT_ONCE:
            (grams, counts), held = merge(), []
    return merge() if held else (grams, counts)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, ties in the order of their numbers (``grams`` is sorted)."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def document_profile(text: str | None, size: int = PROFILE) -> np.ndarray:
    return ranked(*counted(ngrams(slices(text))), size)


class Profiles:
    """The profiles of all languages, ready for comparison."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.languages, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([np.array(profiles[k], np.int64) for k in self.languages])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.grams), len(self.languages)), -1, np.int64)
        for i, k in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, profiles[k]), i] = np.arange(len(profiles[k]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The nearest language (the first in order among equals) and how near it is: 1 less its share of the largest distance."""
        own = document_profile(text, self.size)
        if not len(own) or not len(self.grams):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        theirs = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        out = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(out.argmin())
        return self.languages[best], 1.0 - float(out[best]) / (self.size * len(own))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is outside the training fold: the checksum of its number leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's profile, counted over all rows of ``df`` whose language is not null.

    Every Arrow batch gives one row per language and n-gram, Spark sums them, and only the ``size`` most
    frequent n-grams of each language come to the driver. Their number is bounded by the alphabets.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        by: dict[str, list[str]] = defaultdict(list)
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by[lang].append(text)
        parts = {k: counted(g for text in v for g in ngrams(slices(text))) for k, v in by.items()}
        parts = {k: v for k, v in parts.items() if len(v[0])}
        if not parts:
            return None
        names = pa.array([k for k, v in parts.items() for _ in range(len(v[0]))], pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([v[0] for v in parts.values()])), pa.array(np.concatenate([v[1] for v in parts.values()]).astype(np.int64))], ["lang", "gram", "n"])

    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(lang_col).cast("string").alias("lang"))
    counts = map_batches(known, count, "lang string, gram bigint, n bigint", rows=None).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    out: dict[str, list[int]] = defaultdict(list)
    for row in top.orderBy("lang", "rank").collect():
        out[row["lang"]].append(row["gram"])
    return dict(out)


def predict_languages(df: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """``carry`` columns of ``df`` with ``lang_pred`` and ``score`` (0 to 1) for each whole text; text without a letter is ``und``, score 0."""
    fields = [df.schema[c] for c in carry]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        against = Profiles(profiles, size)
        found = [against.nearest(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*carry, "lang_pred", "score"])

    return map_batches(df.select(F.col(text_col).alias("__text"), *carry), run, schema)


def identify_languages(df: DataFrame, carry: tuple[str, ...] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """Learn from the documents outside the held-out fold, then predict all.

    ``df`` has doc_id, text and lang. A null doc_id counts as training fold, a null lang is not learned from,
    repeated rows count as often as they occur and ties go to the smaller n-gram or the first language in
    order. With nothing to learn from, every language is ``und``.
    """
    profiles = train_profiles(df.where(~held_out()), size=size)
    return predict_languages(df.withColumn("held_out", held_out()), profiles, carry=(*carry, "held_out"), size=size)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
