"""Benchmark decontamination in DataFrame functions only.

An item of n words is sought in windows of n words of each document. Texts become lower-case words (runs of
letters and digits), and a shingle is five words in a row (all words of an item that has fewer).

1. *Anchors.* A window as similar as asked shares most of its shingles with the item. The documents'
   shingles meet the benchmark's, and only windows that hold enough anchors go on. This loses nothing.
2. *Fingerprints.* The remaining windows and all items get a 64-bit SimHash over their weighted shingles.
3. *Multi-index blocks.* Fingerprints are cut into eight blocks of eight bits. Two that differ in at most 23 bits
   have a block in which they differ in at most two, so each item is entered under the values near its own
   in each block, and each window asks for its eight values: all within the radius are found.
4. *Verification.* The weighted Jaccard similarity of the shingles, weight being how often one occurs, is
   computed exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import staged, table

SHINGLE, SIMILARITY = 5, 0.8
#: Blocks of a fingerprint, and the radius up to which all are found: at most NEAR differing bits in some block.
BLOCKS, NEAR = 8, 2
BLOCK_BITS = 64 // BLOCKS
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Most bytes of the benchmark's side, or of marked documents, that are broadcast; beyond it, both sides are shuffled.
BROADCAST_BYTES = 24 << 20


def words_of(text: Column) -> Column:
    """The text's words in lower case, joined by one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def shingles_of(words: Column, width: int) -> Column:
    """All runs of ``width`` words, in order: element i starts at word i."""
    return F.regexp_extract_all(words, F.lit(rf"(?<!\S)(?=(\S+{r' \S+' * (width - 1)}))\S+"), F.lit(1))


def hashes_of(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def bounded(df: DataFrame, width: Column) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``BROADCAST_BYTES``; ``width`` tells the bytes of a row."""
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0] <= BROADCAST_BYTES else df


def simhash_of(hashes: Column) -> Column:
    """The 64-bit SimHash of an array of hashes; a hash that occurs often weighs as much more."""
    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
        return F.when(votes * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def block(fp: Column, number: Column) -> Column:
    return F.call_function("shiftright", fp, number * F.lit(BLOCK_BITS)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int")


def near_values() -> list[int]:
    """What a block's value may be XORed with: up to NEAR bits."""
    return [sum(1 << i for i in c) for k in range(NEAR + 1) for c in combinations(range(BLOCK_BITS), k)]


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger weights, a weight being how often an element occurs."""
    def times(x: Column, h: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == h))

    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, h: acc + F.least(times(a, h), times(b, h)))
    return common / (F.size(a) + F.size(b) - common)


def benchmark_items(benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """item_id, width, shingles and m (their number) of every item with a word."""
    words = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where("words <> ''")
    counted = words.withColumn("n", F.size(F.split("words", " "))).withColumn("width", F.least(F.lit(SHINGLE), "n"))
    by_width = None
    for w in range(1, SHINGLE + 1):
        by_width = F.when(F.col("width") == w, hashes_of(shingles_of(F.col("words"), w))) if by_width is None else by_width.when(F.col("width") == w, hashes_of(shingles_of(F.col("words"), w)))
    return counted.select("item_id", "width", by_width.alias("item_hashes")).withColumn("m", F.size("item_hashes"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, similarity and the word where the best window starts.

    Null texts, ids of items without a word and empty tables give no rows. Rows with the same id and text are one
    document; rows with the same id and other text are judged each, and the best is returned. Of equal
    windows the first is returned. A window that would pass a document's end is cut there.
    """
    items = staged(benchmark_items(benchmark), "items")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    out = None
    for width in [r["width"] for r in items.select("width").distinct().collect()]:  # at most SHINGLE values
        found = _leaks_of_width(base, items.where(F.col("width") == width), width, similarity)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return base.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word")).where(F.lit(False))
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("back")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).cast("int").alias("start_word"))


def _leaks_of_width(base: DataFrame, items: DataFrame, width: int, similarity: float) -> DataFrame:
    # a shingle of the benchmark with the sizes of the items that hold it
    posting = staged(items.select("m", F.explode("item_hashes").alias("hash")).groupBy("hash").agg(F.collect_set("m").alias("sizes")), "posting")
    shingles = base.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(shingles_of(words_of(F.col("text")), width)).alias("pos", "shingle"))
    hits = shingles.select("doc_id", "version", "pos", F.xxhash64("shingle").alias("hash")).join(bounded(posting, 24 + F.size("sizes") * 4), "hash").select("doc_id", "version", "pos", F.explode("sizes").alias("m"))
    # two lists of m shingles as similar as s have at least s * m in common; a window starts at most m - s * m before its first anchor
    needed = F.ceil(F.col("m") * F.lit(similarity) - F.lit(1e-9)).cast("int")
    by_doc = hits.groupBy("doc_id", "version", "m").agg(F.sort_array(F.collect_set("pos")).alias("at")).withColumn("needed", needed)
    # places are in order, so a window has enough of them if the last one that it needs is not too far away
    dense = F.filter("at", lambda p, i: F.coalesce(F.get("at", i + F.col("needed") - 1) < p + F.col("m"), F.lit(False)))
    starts = F.array_distinct(F.flatten(F.transform("dense", lambda p: F.sequence(F.greatest(p - F.col("m") + F.col("needed"), F.lit(0)), p))))
    places = by_doc.where(F.size("at") >= F.col("needed")).withColumn("dense", dense).where(F.size("dense") > 0).select("doc_id", "version", "m", starts.alias("starts"))
    places = staged(places.groupBy("doc_id", "version").agg(F.collect_list(F.struct("m", "starts")).alias("places")), "places")
    same = (F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))) & (F.xxhash64("d.text") == F.col("p.version"))
    marked = base.alias("d").join(bounded(places, F.aggregate("places", F.lit(40), lambda a, p: a + 16 + F.size(p["starts"]) * 4)).alias("p"), same).select("d.doc_id", "p.version", "p.places", hashes_of(shingles_of(words_of(F.col("d.text")), width)).alias("hashes"))
    marked = staged(marked, "marked")
    spread = marked.select("doc_id", "version", "hashes", F.explode("places").alias("p")).select("doc_id", "version", "hashes", F.col("p.m").alias("m"), F.explode("p.starts").alias("start"))
    windows = spread.select("doc_id", "version", "m", "start", F.slice("hashes", F.col("start") + 1, F.col("m")).alias("window")).dropDuplicates(["doc_id", "version", "m", "start"])
    windows = staged(windows.withColumn("fp", simhash_of(F.col("window"))), "windows")

    blocks = F.array(*(F.lit(b) for b in range(BLOCKS)))
    near = F.array(*(F.lit(x) for x in near_values()))
    known = items.withColumn("item_fp", simhash_of(F.col("item_hashes")))
    entries = staged(known.select("item_id", "m", "item_fp", F.explode(blocks).alias("block")).select("item_id", "m", "item_fp", "block", F.explode(near).alias("x")).select("item_id", "m", "item_fp", "block", block(F.col("item_fp"), F.col("block")).bitwiseXOR(F.col("x")).alias("value")), "entries")
    asked = windows.select("doc_id", "version", "m", "start", "fp", F.explode(blocks).alias("block")).withColumn("value", block(F.col("fp"), F.col("block")))
    candidates = asked.join(bounded(entries, F.lit(40)), ["m", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("doc_id", "version", "m", "start", "item_id").distinct()
    pairs = candidates.join(windows.select("version", "m", "start", F.col("doc_id").alias("d"), "window"), ["version", "m", "start"]).where(F.col("doc_id").eqNullSafe(F.col("d")))
    return (
        pairs.join(bounded(items.select("item_id", "item_hashes"), 24 + F.size("item_hashes") * 8), "item_id")
        .withColumn("similarity", weighted_jaccard(F.col("window"), F.col("item_hashes")))
        .where(F.col("similarity") >= similarity)
        .select("doc_id", "item_id", "similarity", F.col("start").alias("start_word"))
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of all benchmark items in all documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
