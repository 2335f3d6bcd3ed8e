"""Models inside the normaliser: segmenters, stemmers and translators, asked once for each different word or phrase of a corpus.

The words that no rule knows are collected from all texts and made distinct, models see them in Arrow batches, and what
they say is joined back. A model is a function from a list of strings to a list as long; it is sent to the workers as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions import words
from tessitura.functions.rewriting import collapse, let
from tessitura.plans.cascade import SERVICE, Rules, grouped, softened, speak
from tessitura.sources.writers import kept

Model = Callable[[list[str]], list[str]]
#: Bytes up to which a table of readings is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Labels of words that may stand in a phrase to be translated, and the one that makes it one.
IN_PHRASE, FOREIGN = ("EN", "CAPITAL", "NOT_LANG"), "EN"
#: Stand in phrases: ends one, and comes before words that may be in one, and before foreign ones. No text has them.
BREAK, INSIDE, TOLD = "\x1e", "", ""


def asked(values: DataFrame, on: str, model: Model, to: str) -> DataFrame:
    """The distinct values of ``on`` with ``to``, what the model says of each; every value is asked for once, and the answers are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(batch.column(0).to_pylist()), pa.string())], [on, to])

    return kept(values.select(on).where(F.col(on).isNotNull()).distinct().mapInArrow(run, f"{on} string, {to} string"), "answers")


def sized(table: DataFrame, *texts: str) -> DataFrame:
    """With a broadcast hint if its texts are counted and small."""
    size = table.agg(F.sum(sum((F.octet_length(t) + 16 for t in texts), F.lit(16)))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def bare(word: Column) -> Column:
    """A word without the digit at its end."""
    return F.regexp_replace(word, r"\d$", "")


def word_readings(unknown: DataFrame, segment: Model | None = None, stem: Model | None = None) -> DataFrame:
    """(word, reading) of distinct words (column word): reading is an array of (stem, ending, root), one for each word that the segmenter sees in it.

    A digit at the end is kept from both models and stays with the last stem.
    """
    word = F.col("word")
    if segment:
        answers = asked(unknown.select(bare(word).alias("bare")), "bare", segment, "apart")
        told = unknown.withColumn("bare", bare(word)).join(sized(answers, "bare", "apart"), "bare", "left")
        apart = F.filter(F.split(F.concat(F.coalesce("apart", "bare"), F.regexp_extract(word, r"(\d?)$", 1)), r"\s+"), lambda p: p != "")
        told = kept(told.select("word", apart.alias("pieces")), "pieces")
    else:
        told = unknown.select("word", F.array(word).alias("pieces"))
    if not stem:
        return told.select("word", F.transform("pieces", lambda p: F.struct(p.alias("stem"), F.lit("").alias("ending"), F.lit(None).cast("string").alias("root"))).alias("reading"))
    pieces = told.select("word", F.posexplode("pieces").alias("at", "piece"))
    stems = asked(pieces.select(bare(F.col("piece")).alias("bare")), "bare", stem, "root")
    cut = pieces.withColumn("bare", bare(F.col("piece"))).join(sized(stems, "bare", "root"), "bare", "left").select("word", "at", words.without_affixes("piece", "root").alias("p"))
    # the pieces of one word, a handful
    ordered = F.array_sort(F.collect_list(F.struct("at", *(F.col(f"p.{k}").alias(k) for k in ("stem", "ending", "root")))))
    return cut.groupBy("word").agg(ordered.alias("o")).select("word", F.transform("o", lambda p: F.struct(*(p[k].alias(k) for k in ("stem", "ending", "root")))).alias("reading"))


def speak_with(df: DataFrame, column: str, key: str, rules: Rules = SERVICE, english: Column | bool = False, segment: Model | None = None, stem: Model | None = None) -> DataFrame:
    """``speak``, where words that no rule knows are cut by a segmenter and a stemmer. ``key`` tells the rows; rows of one key must have one text."""
    told = grouped(df, column, rules)
    rest = F.transform(F.filter("__t", lambda g: g["kind"] == "rest"), lambda g: softened(g["w"]))
    unknown = kept(told.select(key, F.explode(F.array_distinct(rest)).alias("word")).distinct(), "unknown")
    found = kept(word_readings(unknown.select("word").distinct(), segment, stem), "readings")
    own = unknown.join(sized(found, "word", "word"), "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "reading"))).alias("__readings"))
    return speak(told.join(own, key, "left"), column, rules, english, "__readings").drop("__readings")


def phrases(found: Column, labels: Column) -> Column:
    """The words of an array in runs: (phrase, foreign). Words that may stand in a phrase are joined with those beside them, all others stand alone.

    A run is foreign if one of its words is. Laughter, sighs, tags and words in capitals stand in no phrase. Words beyond the labels have none.
    """

    def run(pairs: Column) -> Column:
        held = lambda p: p["label"].isin(*IN_PHRASE) & ~words.sounds_like(p["word"], words.LAUGHS) & ~words.sounds_like(p["word"], words.SIGHS)
        marked = F.transform(pairs, lambda p: F.when(F.coalesce(held(p), F.lit(False)), F.concat(F.when(p["label"] == FOREIGN, TOLD).otherwise(INSIDE), p["word"])).otherwise(F.concat(F.lit(BREAK), p["word"], F.lit(BREAK))))
        cut = F.filter(F.split(F.array_join(marked, " "), BREAK), lambda s: F.trim(s) != "")
        return F.transform(cut, lambda s: F.struct(F.trim(F.translate(s, INSIDE + TOLD, "")).alias("phrase"), F.contains(s, F.lit(TOLD)).alias("foreign")))

    return let(F.zip_with(found, labels, lambda w, k: F.struct(F.coalesce(w, F.lit("")).alias("word"), k.alias("label"))), run)


def translate_runs(df: DataFrame, column: str, key: str, label: Callable[[Column], Column], translate: Model) -> DataFrame:
    """``column`` with each run of words in the foreign language translated as one phrase; null stays null.

    ``label`` gives an array of labels for an array of words; ``translate`` is asked once for each different phrase. ``key`` tells the rows; rows of one key must have one text.
    """
    split = F.filter(F.split(F.col(column), r"\s+"), lambda w: w != "")
    runs = df.withColumn("__runs", F.when(F.col(column).isNotNull(), let(split, lambda w: phrases(w, label(w)))))
    foreign = F.array_distinct(F.transform(F.filter("__runs", lambda r: r["foreign"]), lambda r: r["phrase"]))
    own = kept(runs.select(key, F.explode(foreign).alias("phrase")).distinct(), "phrases")
    answers = asked(own, "phrase", translate, "translated")
    table = own.join(sized(answers, "phrase", "translated"), "phrase").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("phrase", "translated"))).alias("__said"))
    said = lambda r: F.when(r["foreign"], F.coalesce(F.try_element_at(F.col("__said"), r["phrase"]), r["phrase"])).otherwise(r["phrase"])
    return runs.join(table, key, "left").withColumn(column, collapse(F.array_join(F.transform("__runs", said), " "))).drop("__runs", "__said")
