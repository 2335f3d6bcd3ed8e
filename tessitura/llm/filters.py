"""How corpus filters interact: what each removes in every order, alone, in vain, and on average over all orders.

Five filters look at a text: too few words (A), too few different words (B), too many capitals (C), marks of code and tables (D), and a
copy of a text with a smaller id (E). Every document gets the *mask* of the filters that it fails. A part of the corpus then is a table of
at most 32 counts, from which all 120 orders follow by sums: what a prefix of an order keeps depends on the set of its filters only.

Copies are found by partition refinement: documents are split by their length in code points, and each class by the hash of a first
block, a second, and so on, where blocks grow fourfold, so that few rounds reach the end of any text. Classes of one document are dropped after every
round. What survives is compared by whole texts, and all but the smallest id of equal texts are marked.

Rows are narrow but for the two scans of texts. Counts of classes are summed up before they are shuffled, and classes are kept by a join on a table
of its own, which Spark can split where a class is large. Whole texts are grouped by themselves, summed up before the shuffle: of a
class of copies every task sends one.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import map_batches, settled, staged, table, text_bytes

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bytes of the first block; each further block is four times as long.
BLOCK = 256
#: Classes (of 8 bytes) up to which they are sent to all tasks instead of shuffling texts.
BROADCAST_CLASSES = 1_000_000
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))
COPY = 1 << FILTERS.index("E")


def text_mask(text: bytes | None) -> int:
    """The bits of the filters A to D that a text fails."""
    text = text or b""
    words = text.split()
    points = len(text.translate(None, CONTINUED))
    failed = (
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * (len(text) - len(text.translate(None, CAPITALS))) > 5 * points,
        len(text) > len(text.translate(None, MARKS)),
    )
    return sum(1 << i for i, fails in enumerate(failed) if fails)


def block_hashes(text: Column, block: int = BLOCK) -> Column:
    """The hashes of a text's successive blocks of bytes, none of an empty text."""
    raw = text.cast("binary")
    long = F.lit(block).cast("long")
    size = lambda i: F.call_function("shiftleft", long, 2 * i)
    start = lambda i: F.floor((size(i) - long) / 3)
    which = F.filter(F.sequence(F.lit(0), F.lit(14)), lambda i: start(i) < F.octet_length(text))
    return F.transform(which, lambda i: F.xxhash64(F.substring(raw, (start(i) + 1).cast("int"), F.least(size(i), F.lit(1 << 30)).cast("int"))))


def class_after(rounds: int) -> Column:
    """The class of a row (points, blocks) after so many rounds: its length and blocks, one hash after the other."""
    out = F.xxhash64("points")
    for i in range(rounds):
        out = F.xxhash64(out, F.get("blocks", F.lit(i)))
    return out


def same_length_and_blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows (doc_id, points, blocks) whose class has others to the last block, as doc_id and class, and the number of rounds."""
    rounds = rows.agg(F.max(F.size("blocks"))).first()[0] or 0
    alive = rows.withColumn("class", class_after(0))
    for i in range(rounds + 1):
        several = staged(alive.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), "classes")
        alive = alive.join(several, "class", "left_semi")
        if i < rounds:
            alive = alive.withColumn("class", F.xxhash64("class", F.get("blocks", F.lit(i))))
        alive = staged(alive, "alive")
    return alive.select("doc_id", "class"), rounds


def first_of_texts(texts: DataFrame) -> DataFrame:
    """class and the smallest doc_id of each different text of rows (doc_id, class, text); null if no row has an id."""
    return texts.groupBy("class", "text").agg(F.min("doc_id").alias("doc_id")).select("class", "doc_id")


def copies(df: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows (doc_id, class) of ``df`` (doc_id, text) that have a text of a smaller id; ``rows`` has its doc_id, points and blocks."""
    alive, rounds = same_length_and_blocks(rows)
    classes = staged(alive.select("class").distinct(), "surviving")
    told = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = told.select("doc_id", "text", F.length("text").alias("points"), block_hashes(F.col("text")).alias("blocks")).select("doc_id", "text", class_after(rounds).alias("class"))
    kept = told.join(F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes, "class", "left_semi")
    first = first_of_texts(kept).withColumnsRenamed({"doc_id": "first_id", "class": "first_class"})
    later = alive.join(first, (F.col("class") == F.col("first_class")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_anti")
    return later.distinct(), rounds


def filter_masks(df: DataFrame, part_col: str = "source") -> DataFrame:
    """doc_id, part and mask of every row of ``df`` (doc_id, text and ``part_col``): bit i is set if it fails the i-th filter.

    A null text is an empty one and a null part the empty string. A null id is larger than all others: with an id among its copies the row
    is a copy, without one it is none. Repeated rows are repeated: rows of one id and text are not copies of each other.
    """
    base = df.select("doc_id", F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    wide = base.select("doc_id", "part", F.length("text").alias("points"), block_hashes(F.col("text")).alias("blocks"), "text")
    names = ["doc_id", "part", "points", "blocks"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(list(map(text_mask, text_bytes(batch.column(4)))), pa.int32())], [*names, "mask"])

    schema = ", ".join(f"{c} {wide.schema[c].dataType.simpleString()}" for c in names) + ", mask int"
    rows = staged(map_batches(wide, run, schema), "masks")
    later, rounds = copies(base, rows)
    later = later.withColumnsRenamed({"doc_id": "copy_id", "class": "copy_class"}).withColumn("copy", F.lit(COPY))
    told = rows.withColumn("class", class_after(rounds)).join(later, (F.col("class") == F.col("copy_class")) & F.col("doc_id").eqNullSafe(F.col("copy_id")), "left")
    return told.select("doc_id", "part", F.col("mask").bitwiseOR(F.coalesce("copy", F.lit(0))).alias("mask"))


def audit(masks: DataFrame) -> DataFrame:
    """One row per part, order and step from rows (part, mask, good, toxic); ``good`` and ``toxic`` are booleans.

    kept: documents that this step leaves; removed: those it takes; redundant: those that fail its filter but were removed earlier; unique_fails: those that
    fail no other filter; good_lost and toxic_lost: of the removed ones; shapley: what its filter removes, summed over all orders.
    """
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    nothing = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")))
    added = lambda a, c: F.struct(*((a[k] + c[k]).alias(k) for k in ("n", "good", "toxic")))
    left = lambda s: F.aggregate(F.filter("cells", lambda c: c["mask"].bitwiseAND(s) == 0), nothing, added)
    parts = parts.select("part", "cells", F.transform(F.sequence(F.lit(0), F.lit(31)), left).alias("left"))
    bits = F.array(*(F.lit(1 << i) for i in range(5)))
    # a set of k filters stands before a given one in k! (4 - k)! orders
    orders = F.array(*(F.lit(x).cast("long") for x in (24, 6, 4, 6, 24)))
    gain = lambda s, f: F.get(orders, F.bit_count(s)) * (F.get("left", s)["n"] - F.get("left", s.bitwiseOR(f))["n"])
    shapley = F.transform(bits, lambda f: F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda s: s.bitwiseAND(f) == 0), F.lit(0).cast("long"), lambda a, s: a + gain(s, f)))
    alone = F.transform(bits, lambda f: F.aggregate(F.filter("cells", lambda c: c["mask"] == f), F.lit(0).cast("long"), lambda a, c: a + c["n"]))
    steps = parts.select("part", "left", shapley.alias("shapley"), alone.alias("alone"), F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    own = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    earlier = sum(F.when(F.locate(c, F.col("filter_order")) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(FILTERS))
    steps = steps.select("*", own.alias("own"), F.call_function("shiftleft", F.lit(1), own).alias("bit"), earlier.alias("earlier"))
    before, after = F.get("left", F.col("earlier")), F.get("left", F.col("earlier").bitwiseOR(F.col("bit")))
    failing = F.get("left", F.lit(0))["n"] - F.get("left", F.col("bit"))["n"]
    removed = {k: before[k] - after[k] for k in ("n", "good", "toxic")}
    return steps.select(
        "part", "filter_order", "step", after["n"].alias("kept"), removed["n"].alias("removed"), (failing - removed["n"]).alias("redundant"),
        F.get("alone", F.col("own")).alias("unique_fails"), removed["good"].alias("good_lost"), removed["toxic"].alias("toxic_lost"), F.get("shapley", F.col("own")).alias("shapley"),
    )


def filter_audit(df: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """The audit of all documents, with labels (doc_id, quality, toxic) for good_lost and toxic_lost.

    Of several labels of one id any 1 counts, and rows without a label are neither good nor toxic. No documents, no rows.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = filter_masks(df, part_col).join(known, "doc_id", "left")
    return audit(marked.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters do to the documents of every source, in all orders."""
    return settled(spark, "audit", lambda: filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: Words, capitals and marks by patterns, copies by a window over whole texts, and one row per document and order.
OP13_SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
),
marks AS (
  SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    doc_id > min(doc_id) OVER (PARTITION BY t) AS e
  FROM docs
),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, o, (a::INT + b::INT + c::INT + d::INT + e::INT) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS own_of,
    least(CASE WHEN a THEN instr(o, 'A') ELSE 6 END, CASE WHEN b THEN instr(o, 'B') ELSE 6 END, CASE WHEN c THEN instr(o, 'C') ELSE 6 END,
      CASE WHEN d THEN instr(o, 'D') ELSE 6 END, CASE WHEN e THEN instr(o, 'E') ELSE 6 END) AS gone
  FROM marks LEFT JOIN known USING (doc_id), orders
),
steps AS (
  SELECT part, o AS filter_order, step, substr(o, step, 1) AS l,
    CASE substr(o, step, 1) WHEN 'A' THEN own_of.A WHEN 'B' THEN own_of.B WHEN 'C' THEN own_of.C WHEN 'D' THEN own_of.D ELSE own_of.E END AS own, fails, good, toxic, gone
  FROM failed, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
counts AS (
  SELECT part, filter_order, step, l, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
    count(*) FILTER (own AND gone < step) AS redundant, count(*) FILTER (own AND fails = 1) AS unique_fails,
    count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM counts
"""
