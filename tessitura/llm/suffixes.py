"""Removal of repeated byte strings with a run-length index over the repetitive part of a corpus.

A byte is removed if it lies in a string of ``length`` bytes that also starts earlier. Two things keep what is
dealt between executors small, and neither changes a result.

*Chunks.* Texts are cut at content-defined places, about every 512 bytes. If a chunk and the ``length - 1`` bytes after
it are also found earlier, all strings that start in it repeat, and later copies need no closer look: the first
occurrence stands for them. *Anchors.* A string's anchor is its smallest ``GRAM``-byte piece by hash (the last of equals).
Equal strings have equal anchors at equal places, so all occurrences of a string are found among those of its anchor.

1. Chunks are grouped by a cryptographic hash of 128 bits, and the first occurrence of each is entered in a bit map of fixed size. A
   chunk whose bit is not set is a later copy. A bit that is set by chance only costs a closer look.
2. Anchors of the strings in first chunks are counted; those that occur again are entered in another map.
3. For each anchor that may repeat, a document gives its *context*, the bytes of all strings with this anchor.
   Contexts are dealt by anchor; those of a frequent anchor are cut by where it lies in the strings and dealt by what such strings share. Each task joins the distinct contexts of its anchors to texts of bounded size,
   builds the run-length index of each, streams matching statistics and marks the long matches.
4. The marked strings of a document meet its text.

**Run-length index.** The suffixes of the text are sorted and their Burrows-Wheeler transform is cut into runs; two suffixes are
kept for each run, its first one and the last of the run before. The longest common prefix with the lexicographic predecessor is measured
at the runs' starts only; inside a run it is one less than at the position before, and the predecessor steps on as well, so a single pass over the
text streams the matching statistics. Suffixes that agree on ``length`` bytes are neighbours; all but the first in the text repeat.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import bit_map, has_bits, map_batches, staged, table, text_bytes

LENGTH, GRAM = 100, 32
#: Bytes of a chunk on average (a power of two), and of the pieces whose hashes end it.
CHUNK, CHUNK_GRAM = 512, 16
#: Strings of a text that are looked at together.
PIECE = 1 << 20
#: log2 of the bits of the maps of first chunks and of repeated anchors.
FILTER_BITS = 28
#: Occurrences of an anchor beyond which its strings are dealt by class, log2 of the bits of the map of such anchors, and places of the anchor in a class.
FREQUENT, FREQUENT_BITS, CLASS = 1000, 24, 9
#: Bytes of contexts that one index covers, unless a single anchor has more.
INDEXED = 6 << 20
#: Never occurs in UTF-8; stands between contexts.
BETWEEN = 0xFF
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all pieces of ``width`` bytes, by doubling; the last step joins two pieces that may overlap."""
    h, k = data.astype(np.uint64) + np.uint64(1), 1
    while k < width:
        step = min(k, width - k)
        h = h[:-step] * np.uint64(pow(BASE, k, 1 << 64)) + h[step:]
        k += step
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    low, k = x, 1
    while k * 2 <= width:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    n = len(x) - width + 1
    return np.minimum(low[:n], low[width - k : width - k + n])


def anchors(text: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece (hashes, first, last, place): the anchors, the first and last string start that each belongs to, and where it starts itself."""
    strings = len(text) - length + 1
    for start in range(0, strings, PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE, strings - start) + length - 1, start)
        h = gram_hashes(data, GRAM)
        n = len(h)
        bits = max(1, n.bit_length())
        most = np.uint64((1 << bits) - 1)
        low = sliding_min((h & ~most) | (most - np.arange(n, dtype=np.uint64)), length - GRAM + 1)
        at = (most - (low & most)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        yield h[at[first]].view(np.int64), first + start, last + start, at[first] + start


def chunks(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks start, and where the last string that starts in each does (exclusive)."""
    strings = len(text) - length + 1
    starts = [np.zeros(1, np.int64)]
    for start in range(0, strings, PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE, strings - start) + CHUNK_GRAM - 1, start)
        found = np.flatnonzero(gram_hashes(data, CHUNK_GRAM) >> np.uint64(20) & np.uint64(CHUNK - 1) == 0) + start
        starts.append(found[found > 0])
    out = np.concatenate(starts)
    return out, np.append(out[1:], strings)


def chunk_keys(doc: int, version: int, text: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, hash, hash, own number) of each chunk; the hashes cover all bytes of the strings that start in it."""
    for a, b in zip(*(x.tolist() for x in chunks(text, length))):
        digest = hashlib.blake2b(text[a : b + length - 1], digest_size=16).digest()
        high, low = struct.unpack(">qq", digest)
        yield a, b, high, low, xxhash.xxh64_intdigest(digest + struct.pack(">qqq", doc, version, a)) - (1 << 63)


def has_bit(bits: np.ndarray, key: int) -> bool:
    at = (key & 0xFFFFFFFFFFFFFFFF) >> 64 - FILTER_BITS
    return bool(int(bits[at >> 6]) >> (at & 63) & 1)


def first_chunks(doc: int, version: int, text: bytes, firsts: np.ndarray, length: int = LENGTH) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The (start, end) of a text's chunks that may be first occurrences, and of those that are certainly later copies."""
    kept: list[tuple[int, int]] = []
    copies: list[tuple[int, int]] = []
    for a, b, _, _, own in chunk_keys(doc, version, text, length):
        (kept if has_bit(firsts, own) else copies).append((a, b))
    return kept, copies


def anchors_within(text: bytes, kept: list[tuple[int, int]], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``anchors`` of the strings that start in the kept chunks; an anchor of strings in several is given for each run of them."""
    if not kept:
        return
    starts, ends = merged(*np.array(kept, np.int64).T)
    for h, first, last, place in anchors(text, length):
        # runs of kept chunks that each anchor's strings reach
        lo, hi = np.searchsorted(ends, first, side="right"), np.searchsorted(starts, last, side="right")
        n = np.maximum(hi - lo, 0)
        owner = np.repeat(np.arange(len(h)), n)
        run = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + lo[owner]
        yield h[owner], np.maximum(first[owner], starts[run]), np.minimum(last[owner], ends[run] - 1), place[owner]


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of strings that each end in BETWEEN, with the suffixes at the ends of its runs.

    The ends count as different bytes, the largest ones, in the order of the strings: no suffix goes beyond its string. The
    order of the suffixes is needed only to find the runs; what is kept besides the text are two suffixes for each run.
    """

    def __init__(self, text: np.ndarray) -> None:
        order = self.sorted(text)
        before = np.where(order > 0, text[order - 1], BETWEEN)
        starts = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == BETWEEN))))
        firsts = order[starts]
        lasts = order[np.append(starts[1:], len(text)) - 1]
        #: the first suffix of each run and the one before it in order (-1: none), by the first's place in the text
        by_place = np.argsort(firsts)
        self.firsts = firsts[by_place]
        self.befores = np.concatenate(([-1], lasts[:-1]))[by_place]

    def sorted(self, text: np.ndarray) -> np.ndarray:
        """The suffixes in order."""
        self.text, n = text, len(text)
        at = np.arange(n)
        #: bytes from each position to the end of its string
        self.left = np.minimum.accumulate(np.where(text == BETWEEN, at, n)[::-1])[::-1] - at
        word, k = np.concatenate((text, np.full(8 + 7, BETWEEN, np.uint8))).astype(np.uint64), 1
        while k < 8:  # the eight bytes from each position on, as a number
            word = word[:-k] << np.uint64(8 * k) | word[k:]
            k *= 2
        short = np.flatnonzero(self.left < 8)
        word[short] |= (np.uint64(1) << (np.uint64(8) * (np.uint64(8) - self.left[short].astype(np.uint64)) - np.uint64(1)) << np.uint64(1)) - np.uint64(1)
        self.words = word
        order = np.argsort(word[:n])
        at_end = self.left[order] < 8  # only these tie with their like for good: they are put in the order of the ends
        ends = order[at_end]
        order[at_end] = ends[np.lexsort((ends, word[ends]))]
        fresh = word[order][1:] != word[order][:-1]
        fresh |= self.left[order][1:] < 8  # equal up to an end: in the order of the ends
        rank = self._ranks(fresh, order)
        while rank.max() < n - 1:
            ahead = np.full(n, n, np.int64)
            ahead[: n - k] = rank[k:]
            key = rank * (n + 1) + ahead
            order = np.argsort(key)
            rank = self._ranks(key[order][1:] != key[order][:-1], order)
            k *= 2
        return order

    @staticmethod
    def _ranks(fresh: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], fresh)))
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lengths of the common prefixes of pairs of suffixes."""
        out, at, most, k = np.zeros(len(a), np.int64), np.arange(len(a)), len(self.text), 0
        while len(at):
            x = self.words[np.minimum(a[at] + k, most)] ^ self.words[np.minimum(b[at] + k, most)]
            same = x == 0
            out[at[same]] += 8
            rest = x[~same]
            zero = np.zeros(len(rest), np.int64)
            for shift in (32, 16, 8):  # leading zero bytes
                clear = rest >> np.uint64(64 - shift) == 0
                zero[clear] += shift // 8
                rest[clear] <<= np.uint64(shift)
            out[at[~same]] += zero
            k += 8
            at = at[same]
            at = at[self.left[a[at]] > k]
        return np.minimum(out, self.left[a])

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its common prefix with the suffix before it in order, streamed from the runs' starts."""
        n = len(self.text)
        measured = np.zeros(n, np.int64)  # length + position at the starts of runs, else 0
        some = self.befores >= 0
        firsts = self.firsts[some]
        measured[firsts] = self.common(firsts, self.befores[some]) + firsts
        return np.maximum(np.maximum.accumulate(measured) - np.arange(n), 0)

    def suffix_before(self, at: np.ndarray) -> np.ndarray:
        """The suffixes before those at some positions in order: inside a run, both step on together from the run's start."""
        run = np.searchsorted(self.firsts, at, side="right") - 1
        return self.befores[run] + (at - self.firsts[run])

    def repeats(self, length: int) -> np.ndarray:
        """Whether the string of ``length`` bytes at each position also starts earlier in the text."""
        at = np.arange(len(self.text))
        again = np.flatnonzero(self.matching_statistics() >= length)
        group = at.copy()  # suffixes that agree on the string are neighbours: each is led to the first of them in order
        group[again] = self.suffix_before(again)
        while True:
            further = group[group[again]]
            if (further == group[again]).all():
                break
            group[again] = further
        earliest = at.copy()
        np.minimum.at(earliest, group[again], again)
        return earliest[group] < at


def intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals; those that touch become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    return starts[fresh], ends[np.append(fresh[1:], len(starts)) - 1]


MARKS = "doc bigint, version bigint, start bigint, end bigint"
MARK_SCHEMA = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def cut_context(text: bytes, first: int, last: int, place: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(key, first, last): the strings of a frequent anchor by how far the anchor lies in them, in classes of ``CLASS``.

    All strings of a class have a core of ``length - CLASS + 1`` bytes in common. Its hash deals them, so equal strings still
    meet, and places with different bytes around the anchor part.
    """
    for c in range((place - last) // CLASS, (place - first) // CLASS + 1):
        core = text[place - c * CLASS : place - (c + 1) * CLASS + 1 + length]
        yield xxhash.xxh64_intdigest(core, c) - (1 << 63), max(first, place - (c + 1) * CLASS + 1), min(last, place - c * CLASS)


def batch_contexts(rows: Iterator[tuple[int, int, bytes]], firsts: np.ndarray, repeated: np.ndarray, frequent: np.ndarray, length: int) -> list[tuple]:
    """(anchor, doc, version, first, None, context) of every distinct context of a batch, and (any number, doc, version, start, end, None) for what is marked already."""
    seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    marks: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, version, text in sorted(rows, key=lambda r: r[:2]):
        for h, first, last, place in anchors_within(text, first_chunks(doc, version, text, firsts, length)[0], length):
            keep = np.flatnonzero(has_bits(repeated, h))
            hot = has_bits(frequent, h[keep])
            for a, p, q, x, many in zip(h[keep].tolist(), first[keep].tolist(), last[keep].tolist(), place[keep].tolist(), hot.tolist()):
                for key, s, e in cut_context(text, p, q, x, length) if many else [(a, p, q)]:
                    context = text[s : e + length]
                    was = seen.setdefault((key, context), (doc, version, s))
                    if was != (doc, version, s):
                        marks.setdefault((doc, version), []).append((s, e + length))
    out = [(a, *key, None, c) for (a, c), key in seen.items()]
    for (doc, version), own in marks.items():
        starts, ends = merged(*np.array(own, np.int64).T)
        out += [(version, doc, version, a, b, None) for a, b in zip(starts.tolist(), ends.tolist())]
    return out


def index_contexts(rows: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """The marks (doc, version, start, end) among complete anchors' contexts (anchor, doc, version, first, None, context), sorted."""
    marks: list[tuple[int, int, int, int]] = []
    distinct: list[tuple] = []
    start = 0
    for end in range(1, len(rows) + 1):
        if end < len(rows) and rows[end][0] == rows[start][0]:
            continue
        if end - start > 1:
            seen: dict[bytes, tuple] = {}
            for r in rows[start:end]:
                was = seen.setdefault(r[5], r)
                if was[1:4] != r[1:4]:
                    marks.append((*r[1:4], r[3] + len(r[5])))
            if len(seen) > 1:
                distinct += seen.values()
        start = end
    if distinct:
        mark = bytes([BETWEEN])
        text = np.frombuffer(mark.join(r[5] for r in distinct) + mark, np.uint8)
        again = RunLengthIndex(text).repeats(length)
        sizes = np.array([len(r[5]) + 1 for r in distinct])
        begins = np.cumsum(sizes) - sizes
        step = np.zeros(len(text) + 1, np.int64)  # positions where a string of the context starts
        np.add.at(step, begins, 1)
        np.add.at(step, begins + sizes - length, -1)
        inside = np.cumsum(step[:-1]) > 0
        a, b = intervals(again & inside)
        owner = np.searchsorted(begins, a, side="right") - 1
        for i, s, e in zip(owner.tolist(), (a - begins[owner]).tolist(), (b - begins[owner]).tolist()):
            _, doc, version, first, _, _ = distinct[i]
            marks.append((doc, version, first + s, first + e - 1 + length))
    return marks


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and ``kept`` (binary) if asked.

    Every string of ``length`` bytes that also starts earlier, in a document of a smaller id or earlier in the same, is
    removed, overlaps included. Judged is the input. A null text is an empty one; a null id comes before all
    others; rows equal in id and text are one document and get equal results; rows of one id with different texts count
    in the order of their texts' hashes.
    """
    spark = df.sparkSession
    version = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), version.alias("version"), F.col(text_col).alias("text"))

    def long_texts(batch: pa.RecordBatch) -> list[tuple[int, int, bytes]]:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)))
        return [r for r in rows if r[2] and len(r[2]) >= length]

    def chunked(batch: pa.RecordBatch) -> pa.RecordBatch:
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for doc, version, text in long_texts(batch):
            for a, _, high, low, own in chunk_keys(doc, version, text, length):
                key, row = (high, low), (doc, version, a, own)
                if key not in best or row < best[key]:
                    best[key] = row
        rows = [(*k, *v) for k, v in best.items()]
        names = ["high", "low", "doc", "version", "start", "own"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names)

    source = docs.select("doc", "version", "text")
    found = map_batches(source, chunked, "high bigint, low bigint, doc bigint, version bigint, start bigint, own bigint", rows=None)
    earliest = found.groupBy("high", "low").agg(F.min(F.struct("doc", "version", "start", "own")).alias("first"))
    firsts = spark.sparkContext.broadcast(bit_map(earliest.select("first.own"), "own", FILTER_BITS))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = [h for doc, version, text in long_texts(batch) for h, *_ in anchors_within(text, first_chunks(doc, version, text, firsts.value, length)[0], length)]
        if not parts:
            return None
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["anchor", "n"])

    again = map_batches(source, counted, "anchor bigint, n bigint", rows=None).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    again = staged(again, "anchors")
    repeated = spark.sparkContext.broadcast((bit_map(again, "anchor", FILTER_BITS), bit_map(again.where(F.col("n") > FREQUENT), "anchor", FREQUENT_BITS)))

    def contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = batch_contexts(long_texts(batch), firsts.value, *repeated.value, length)
        kinds = (*[pa.int64()] * 5, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["anchor", "doc", "version", "first", "end", "bytes"])

    dealt = map_batches(source, contexts, "anchor bigint, doc bigint, version bigint, first bigint, end bigint, bytes binary", rows=None)
    dealt = dealt.repartition("anchor").sortWithinPartitions("anchor", "doc", "version", "first")

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(MARK_SCHEMA)], schema=MARK_SCHEMA)

        held: list[tuple] = []
        size = 0
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            yield told([r[1:5] for r in rows if r[5] is None])
            for r in rows:
                if r[5] is None:
                    continue
                if size >= INDEXED and held[-1][0] != r[0]:
                    yield told(index_contexts(held, length))
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield told(index_contexts(held, length))

    marks = dealt.mapInArrow(indexed, MARKS).groupBy("doc", "version").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    id_type = df.schema[id_col].dataType.simpleString()

    def finished(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        lists = batch.column(4)
        fields = lists.values.flatten()  # of the whole batch; the offsets are those of the slice
        starts_all, ends_all, cut = fields[0].to_numpy(), fields[1].to_numpy(), lists.offsets.to_numpy()
        for i, (doc, version, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(3)))):
            text, a, b = text or b"", cut[i], cut[i + 1]
            copies = first_chunks(doc, version, text, firsts.value, length)[1] if len(text) >= length else []
            more = np.array(copies, np.int64).reshape(-1, 2)
            starts, ends = np.concatenate((starts_all[a:b], more[:, 0])), np.concatenate((ends_all[a:b], more[:, 1] + length - 1))
            starts, ends = merged(starts, ends) if len(starts) else (starts, ends)
            at = [0, *np.stack((starts, ends), axis=1).reshape(-1).tolist(), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(at[::2], at[1::2]))
            rows.append((len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        shown = 5 if keep_text else 4
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(shown))], ["doc_id", *names[:shown]])

    joined = docs.join(marks.hint("shuffle_hash"), ["doc", "version"], "left").select("doc_id", "doc", "version", "text", "marks")
    return map_batches(joined, finished, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 100 bytes that occur earlier."""
    return remove_repeats(table(spark, sf_dir, "documents"))
