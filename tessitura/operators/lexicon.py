"""Membership in word lists and place names, rewrite maps and suffixes, as joins with dimension tables.

A lexicon is a table of (entry, kind). The published word lists are not part of any repository, so they are
parameters; sides are broadcast only if they are counted and small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.rewriting import title

BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if the table has at most ``most`` rows; beyond it the join is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def members(words: DataFrame, entries: DataFrame, on: str = "word", plural: bool = False) -> DataFrame:
    """Rows whose word is an entry, with ``plural`` also those whose word without its final s is."""
    if not plural:
        return words.join(small(entries.select(on).distinct()), on, "left_semi")
    stems = entries.select(on).distinct()
    both = stems.unionByName(stems.where(F.length(on) > 1).select(F.concat(on, F.lit("s")).alias(on))).distinct()
    return words.join(small(both), on, "left_semi")


def strangers(words: DataFrame, entries: DataFrame, on: str = "word") -> DataFrame:
    """Rows whose word is no entry."""
    return words.join(small(entries.select(on).distinct()), on, "left_anti")


def rewrite(words: DataFrame, table: DataFrame, on: str = "word") -> DataFrame:
    """``rewritten``: the table's ``value`` for the word, else the word. Of several values the greatest counts."""
    once = table.groupBy(on).agg(F.max("value").alias("value"))
    return words.join(small(once), on, "left").withColumn("rewritten", F.coalesce("value", on)).drop("value")


def longest_suffix(words: DataFrame, suffixes: DataFrame, on: str = "word") -> DataFrame:
    """``suffix`` and ``value`` of the entry that ends the word and has the longest value.

    Each word gives one row per ending of a length that an entry has, so that the join is on equality.
    """
    lengths = F.array(*(F.lit(r[0]) for r in suffixes.select(F.length("suffix").alias("n")).distinct().where("n > 0").collect()))  # a handful
    endings = words.select(on).distinct().select(on, F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length(on)), lambda n: F.right(F.col(on), n))).alias("suffix"))
    found = endings.join(small(suffixes.select("suffix", "value")), "suffix")
    best = found.groupBy(on).agg(F.max_by(F.struct("suffix", "value"), F.struct(F.length("value"), "suffix")).alias("b")).select(on, "b.suffix", "b.value")
    return words.join(best, on, "left")


#: Letters of a word up to which its length is among those that are cut from longer words; beyond, words are found by their beginning of this many letters.
SHORT = 24


def keep_longest(words: DataFrame, on: str = "word") -> DataFrame:
    """Distinct words that are part of no longer one, found by the pieces of each word rather than by comparing all pairs.

    From a word come its pieces of those lengths up to ``SHORT`` that other words have, and for longer words one piece for each place, which is joined with the beginnings of
    words and verified. So the rows of a word grow with its letters, not with their square.
    """
    distinct = words.select(on).where(F.length(on) > 0).distinct()
    n = F.length(on)
    some = bool(distinct.limit(1).count())  # the empty word is part of any other
    lengths = [r[0] for r in distinct.where(n <= SHORT).select(n.alias("n")).distinct().collect()]  # at most SHORT
    places = distinct.where(n > (min(lengths) if lengths else SHORT)).select(on, F.explode(F.sequence(F.lit(1), n)).alias("at"))
    cut = F.filter(F.transform(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda k: F.when((k < n) & (F.col("at") + k - 1 <= n), F.substring(F.col(on), F.col("at"), k))), lambda p: p.isNotNull())
    parts = places.select(F.explode(cut).alias(on)).distinct()
    # a longer word starts somewhere in an even longer one: their first letters meet, and the rest is compared
    starts = distinct.where(n > SHORT).select(F.col(on).alias("inner"), F.left(F.col(on), F.lit(SHORT)).alias("start"))
    spots = places.where(F.col("at") + SHORT - 1 < n).select(F.col(on).alias("outer"), "at", F.substring(F.col(on), F.col("at"), F.lit(SHORT)).alias("start"))
    inside = spots.join(starts, "start").where((F.length("inner") < F.length("outer")) & (F.substring(F.col("outer"), F.col("at"), F.length("inner")) == F.col("inner")))
    return words.select(on).distinct().join(parts.unionByName(inside.select(F.col("inner").alias(on))).distinct(), on, "left_anti").where((n > 0) | F.lit(not some))


def flagged(words: DataFrame, entries: DataFrame, key: Column, name: str) -> DataFrame:
    """``name``: whether a row's key is an entry (column ``word``)."""
    once = entries.select(F.col("word").alias("__entry")).distinct().withColumn("__is", F.lit(True))
    return words.withColumn("__key", key).join(small(once), F.col("__key") == F.col("__entry"), "left").withColumn(name, F.coalesce("__is", F.lit(False))).drop("__key", "__entry", "__is")


def malay(words: DataFrame, slang: DataFrame, english: DataFrame, lists: DataFrame, on: str = "word") -> DataFrame:
    """``malay``: slang that is no English word (nor one with a final s), in any case, or a word of the lists, in theirs."""
    own = members(slang.select(F.lower("word").alias("word")), english, plural=True)
    rude = slang.select(F.lower("word").alias("word")).distinct().join(own.select("word").distinct(), "word", "left_anti")
    both = flagged(flagged(words, rude, F.lower(on), "__slang"), lists, F.col(on), "__list")
    return both.withColumn("malay", F.col("__slang") | F.col("__list")).drop("__slang", "__list")


def places(words: DataFrame, table: DataFrame, on: str = "word") -> DataFrame:
    """``place``: whether a word is one of the table's (word, kind) places. States are told in lower case, others with capitals."""
    states = table.where("kind = 'state'").select(F.lower("word").alias("word"))
    others = table.where("kind <> 'state'").select("word")
    both = flagged(flagged(words, states, F.lower(on), "__state"), others, title(F.lower(on)), "__other")
    return both.withColumn("place", F.col("__state") | F.col("__other")).drop("__state", "__other")


def best_label(labels: Column) -> Column:
    """The label with the largest score among (label, score) pairs; the first of equals."""
    best = F.array_max(F.transform(labels, lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("at"), x["label"].alias("label"))))
    return best["label"]


def speaks_english(labels: Column) -> Column:
    """Whether the best label of a language model names English."""
    return F.contains(best_label(labels), F.lit("english"))
