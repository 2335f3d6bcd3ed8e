"""From raw documents to encoded ones: five stages, each written as Parquet and read again by the next.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` applies them to the documents of a data folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.bpe import bpe_encode
from tessitura.llm.common import scratch, staged, table, unstaged
from tessitura.llm.decontaminate import leaks
from tessitura.llm.langid import UNKNOWN, identify_languages
from tessitura.llm.pii import find_pii, redact
from tessitura.llm.neardup import similar_components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document as far as this from every language is none: nearness is 0 when it shares no n-gram with the nearest profile.
LEAST_SCORE = 0.05
#: Words of a shingle and least similarity of shingle sets in near_dedup.
SHINGLE, SIMILARITY = 5, 0.8
#: Rows of an Arrow batch in the stages that run Python, so that long texts need little memory on both sides.
BATCH_ROWS = 256
#: Words that a worker remembers in the last stage, where it shares an executor with what the stages before have left.
CACHED_WORDS = 100_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are in some language; those without a letter and those like no language go. ``lang`` becomes the predicted one."""
    small_batches(spark)
    named = identify_languages(docs.select(*COLUMNS), carry=("doc_id", "text", "source", "n_chars"))
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that with the smallest id; rows without an id come last.

    Near-duplicates are found by SimHash in buckets of shared shingles, and every link is verified on whole texts. Rows with one id and
    different texts are different documents: each is judged by its own group.
    """
    small_batches(spark)
    groups = similar_components(docs, width=SHINGLE, similarity=SIMILARITY)
    # a row is told by its id and the hash of its text
    at, own = F.coalesce("doc_id", F.lit(0)), lambda version: F.xxhash64(F.col("doc_id").isNull(), version)
    firsts = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("root", "doc_id", "version")
    kept = firsts.groupBy("root").agg(F.first("doc_id").alias("doc_id"), F.min("version").alias("version")).select(at.alias("at"), own(F.col("version")).alias("own"))
    told = docs.select(*COLUMNS, at.alias("at"), own(F.xxhash64(F.coalesce("text", F.lit("")))).alias("own"))
    return told.join(kept.hint("shuffle_hash"), ["at", "own"], "left_semi").dropDuplicates(["at", "own"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark passage in them, those without an id too; a row is told by its id and its text."""
    told = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("version")).alias("row"))
    found = leaks(told, table(spark, sf_dir, "benchmark"), id_col="row").select(F.col("doc_id").alias("leaked")).distinct()
    return told.join(found, F.col("row") == F.col("leaked"), "left_anti").select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; every document stays. ``n_chars`` follows the text."""
    found = find_pii(docs, carry=("text", "lang", "source"))
    return found.withColumn("text", redact(found, "text", "spans")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with their number and the digest of what they decode to."""
    small_batches(spark)
    return bpe_encode(docs, outputs=("ids", "n_tokens", "decoded_sha256"), cached_words=CACHED_WORDS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("encode", encode),
]

#: SQL has no fingerprints, boosted trees or vocabulary; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, done = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        with scratch(spark) as folders:
            docs = staged(stage(spark, docs, sf_dir), name)
            folders.remove(docs.staged_at)
        unstaged(*done)
        done = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
