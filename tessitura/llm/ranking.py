"""Ranked lexical search, score at a time over postings in the order of their impact.

The index is cut by documents. A part of it holds, for every query term, its postings grouped by exact impact, the highest first. A query walks the groups of
all its terms in the order of what they add to a score, and adds them up per document. After each step it knows how much any document can
still gain: the sum of what the next group of every term would add. It stops only when that proves which documents
of the part may be among the best, and then completes the scores of these from their own postings. What a part has found so far
raises the mark for its later blocks. The best of all parts are ranked by one window.

One scan of the texts leaves a narrow table: each document's length and its counts of query terms. Statistics come from
that table, and nothing but a part's best is shuffled, so a term that all documents have is no hot key. Queries are
sent to all tasks; where they are larger than ``ITEM_BYTES``, they are dealt into groups of that size, each searched on its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tessitura.llm.common import map_batches, settled, staged, table, text_bytes

#: Bytes of query texts that are searched together.
ITEM_BYTES = 1 << 20
#: Postings and documents of a block, the part of an index that is held at once.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 21, 1 << 17
#: A step of a query adds at least so many postings, and at least this share of all that its terms have in the block.
STEP, STEP_SHARE = 2048, 1 / 16
#: Candidates whose scores are completed when they are at most this many, or this share of the documents seen.
FEW, FEW_SHARE = 64, 1 / 16
#: Bytes of a text that are cut into terms at once.
AT_ONCE = 1 << 20
#: Byte by byte: letters, digits and all beyond ASCII stay, A to Z are lower-cased and everything else separates terms.
TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    flat, start = (text or b"").translate(TERMS), 0
    while start < len(flat):
        end = flat.find(b" ", start + AT_ONCE)
        end = len(flat) if end < 0 else end
        yield flat[start:end].split()
        start = end


def with_term_counts(df: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and counts (those of the vocabulary, ascending) of rows doc_id and text; rows without a term are left out."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        number = sent.value.get
        lengths, offsets, terms, counts = [], [0], [], []
        for text in text_bytes(batch.column(1)):
            n, own = 0, []
            for words in terms_of(text):
                n += len(words)
                own.append(np.fromiter(map(number, words, repeat(-1)), np.int32, len(words)))
            ids, times = np.unique(np.concatenate(own) if own else np.zeros(0, np.int32), return_counts=True)
            known = int(np.searchsorted(ids, 0))
            lengths.append(n)
            terms.append(ids[known:])
            counts.append(times[known:])
            offsets.append(offsets[-1] + len(ids) - known)
        ends = pa.array(offsets, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in (terms, counts)]
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
        return out.filter(pa.array(np.array(lengths) > 0))

    return map_batches(df.select("doc_id", "text"), run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n bigint, terms array<int>, counts array<int>", rows=256)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Block:
    """Documents with their query terms, and the same postings by term in groups of one impact, the highest first."""

    def __init__(self, ids: np.ndarray, nameless: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int) -> None:
        self.ids, self.nameless, self.offsets, self.terms, self.impacts = ids, nameless, offsets, terms, impacts
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets))
        key = terms.astype(np.int64) * (1 << 20) + ((1 << 20) - 1 - impacts)  # an impact is at most 10**6
        order = np.argsort(key)
        key = key[order]
        self.docs = owner[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        self.starts = np.flatnonzero(fresh)
        self.sizes = np.diff(np.append(self.starts, len(key)))
        self.impact = (1 << 20) - 1 - (key[self.starts] & ((1 << 20) - 1))
        self.groups = np.searchsorted(key[self.starts] >> 20, np.arange(vocabulary + 1))
        self.sums = np.zeros(len(ids), np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their scores: all that may be among the ``k`` best and reach ``mark``, the score that the k-th of earlier blocks has."""
        first, n = self.groups[terms], self.groups[terms + 1] - self.groups[terms]
        group = ranges(first, n)
        adds = self.impact[group] * np.repeat(weights, n)
        last = np.zeros(len(group), bool)
        last[np.cumsum(n)[n > 0] - 1] = True
        drops = adds - np.where(last, 0, np.append(adds[1:], 0))  # how much less a document can gain once the group is done
        order = np.argsort(-adds, kind="stable")
        group, adds = group[order], adds[order]
        left = np.append(drops.sum(), drops.sum() - np.cumsum(drops[order]))
        sizes = self.sizes[group]
        done = np.cumsum(sizes)
        seen, found, at, sums = np.zeros(0, np.int32), np.zeros(0, np.int64), 0, self.sums
        while at < len(group):
            if left[at] < mark and np.count_nonzero(found + left[at] >= mark) <= max(FEW, len(seen) * FEW_SHARE):
                break  # no new document reaches the mark, and few of those seen still may
            step = max(STEP, int(done[-1] * STEP_SHARE))
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + step, "right")))
            docs = self.docs[ranges(self.starts[group[at:to]], sizes[at:to])]
            np.add.at(sums, docs, np.repeat(adds[at:to], sizes[at:to]))
            at = to
            seen = np.unique(np.concatenate((seen, docs)))
            found = sums[seen]
            if len(found) >= k:
                mark = max(mark, int(np.partition(found, len(found) - k)[len(found) - k]))
        sums[seen] = 0
        few = seen[found + left[at] >= max(mark, 1)]
        if at == len(group):
            return few, found[found >= max(mark, 1)]
        weight = np.zeros(len(self.groups), np.int64)
        weight[terms] = weights
        sizes = np.diff(self.offsets)[few]
        own = ranges(self.offsets[few], sizes)
        ends = np.cumsum(sizes)
        whole = np.append(0, np.cumsum(weight[self.terms[own]] * self.impacts[own]))
        return few, whole[ends] - whole[ends - sizes]


def search_parts(index: DataFrame, items: list[tuple], kinds: tuple[pa.DataType, str], weights: np.ndarray, stats: tuple[int, int], k: int) -> DataFrame:
    """item_id, version, doc_id and score: every part's ``k`` best documents of every item. Items are (item_id, version, terms, repeats)."""
    many, total = stats
    id_type, id_name = kinds
    doc_name = index.schema["doc_id"].dataType.simpleString()
    doc_type = to_arrow_type(index.schema["doc_id"].dataType)
    sent = index.sparkSession.sparkContext.broadcast((items, weights))
    names = ["item_id", "version", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(queries)  # ids, nameless, scores
        held: list[pa.RecordBatch] = []

        def search() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            terms, counts = (rows.column(c).combine_chunks() for c in ("terms", "counts"))
            offsets = np.append(0, np.cumsum(rows.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            m = 75 + 25 * rows.column("n").to_numpy() * many // total
            tf = counts.flatten().to_numpy().astype(np.int64)
            impacts = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(offsets)))
            ids = rows.column("doc_id").combine_chunks()
            nameless = np.array(ids.is_null())
            block = Block(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), nameless, offsets, terms.flatten().to_numpy(), impacts, len(weight))
            for q, (_, _, own, repeats) in enumerate(queries):
                score = weight[own] * repeats
                kept = score > 0
                before = best[q]
                docs, scores = block.best(own[kept], score[kept], k, int(before[2][-1]) if len(before[2]) == k else 0)
                new = [np.concatenate(x) for x in zip(before, (block.ids[docs], block.nameless[docs], scores))]
                order = np.lexsort((new[0], new[1], -new[2]))[:k]
                best[q] = tuple(x[order] for x in new)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_DOCS or sum(len(b.column(2).flatten()) for b in held) >= BLOCK_POSTINGS:
                search()
                held = []
        if held:
            search()
        for (item, version, _, _), (ids, nameless, scores) in zip(queries, best):
            if len(ids):
                columns = [pa.array([item] * len(ids), id_type), pa.array([version] * len(ids), pa.int64()), pa.array(ids, mask=nameless).cast(doc_type), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return index.select("doc_id", "n", "terms", "counts").mapInArrow(run, f"item_id {id_name}, version bigint, doc_id {doc_name}, score bigint")


def prepared(rows: list[Row]) -> tuple[dict[bytes, int], list[tuple]]:
    """The numbers of all query terms, and every item as (item_id, version, its terms in ascending order, how often it has each)."""
    vocabulary: dict[bytes, int] = {}
    items = []
    for row in rows:
        counts = Counter(vocabulary.setdefault(w, len(vocabulary)) for words in terms_of((row["text"] or "").encode("utf-8", "surrogatepass")) for w in words)
        if counts:
            own = np.array(sorted(counts), np.int64)
            items.append((row["item_id"], row["version"], own, np.array([counts[t] for t in own.tolist()], np.int64)))
    return vocabulary, items


def ranked(df: DataFrame, benchmark: DataFrame, k: int = 20, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, version (a hash of the item's text), rank, doc_id and score: the ``k`` best documents (doc_id, text) of every item (item_id, text).

    Only scores above 0 are ranked, and equal scores by ascending id, null ids last. Null texts have no terms; documents without a term count in no
    statistic, and items without one have no rows. Repeated documents are ranked each; repeated items are one, and items of
    one id with different texts are ranked each for itself. Ids of documents are whole numbers.
    """
    items = staged(benchmark.select("item_id", F.xxhash64("text").alias("version"), "text").distinct(), "items")
    groups = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / item_bytes))
    kinds = to_arrow_type(items.schema["item_id"].dataType), items.schema["item_id"].dataType.simpleString()
    found = None
    for g in range(groups):
        vocabulary, queries = prepared(items.where(F.pmod(F.xxhash64("item_id", "version"), F.lit(groups)) == g).orderBy("item_id", "version").collect())
        index = staged(with_term_counts(df, vocabulary), "terms")
        many, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.full(len(vocabulary), math.floor(1000 * math.log(2 * many + 2)), np.int64)
        for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the terms of the queries
            weights[row["term"]] = math.floor(1000 * math.log((2 * many + 2) / (2 * row["count"] + 1)))
        part = search_parts(index, queries, kinds, weights, (many, max(total, 1)), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id", "version").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "version", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    found = settled(spark, "ranked", lambda: ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("item_id", "rank", "doc_id", "score")


#: All documents scored for all items by joins of their terms.
OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
totals AS (SELECT count(*) FILTER (len(terms) > 0) AS many, sum(len(terms))::BIGINT AS total FROM docs),
items AS (
  SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
),
asked AS (SELECT item_id, text, term, count(*) AS times FROM items GROUP BY ALL),
postings AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs),
counts AS (SELECT r, doc_id, n, term, count(*) AS tf FROM postings WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(many) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term
),
scores AS (
  SELECT item_id, text, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * many) // total))))::BIGINT AS score
  FROM counts JOIN weights USING (term) JOIN asked USING (term), totals GROUP BY ALL
),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 20
"""
