"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are compared by multi-index blocks: 64 bits are cut into blocks, and two fingerprints that differ
in at most ``radius`` bits agree on at least ``blocks - radius`` of them, so each combination of that many
blocks is a table in which they share a bucket. Equal fingerprints are one entry throughout.

Within a bucket, fingerprints stand as 64 bit planes, one machine word holding one bit of 64 fingerprints. The
distances of 64 pairs at a time are summed by carry-save counters over the XORed planes, and blocks of words
in which every distance has exceeded the radius are abandoned. Each task keeps the links in a union-find
forest and gives back only the links that joined two trees, never all pairs of a group. Components are then
found by large-star and small-star rounds on DataFrames, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import map_batches, staged, table, text_bytes, unstaged

BITS, SEED = 64, 42
#: Shingles summed at once, so that very long texts need little memory.
SHINGLES_AT_ONCE = 1 << 16
#: Buckets up to this size are compared side by side by shifts; larger ones each against all of their planes.
SHIFTED = 64
#: Fingerprints of a bucket beyond which it is cut into parts that are compared pair by pair of parts.
BUCKET_PART = 4096
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Whether pairs of rows (two arrays of places) may be links at all.
Fits = Callable[[np.ndarray, np.ndarray], np.ndarray]


def shingle_hashes(text: bytes | None, width: int = 4) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, repeats included, in order and some at a time; of fewer words there is one shingle, of none none."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(joined, SEED)] if words else [], np.uint64)
        return
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = len(words) - width + 1
    for a in range(0, n, SHINGLES_AT_ONCE):
        b = min(n, a + SHINGLES_AT_ONCE)
        yield np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts[a:b], ends[a + width - 1 : b + width - 1])], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """A number with the bits that over half of all hashes have."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The SimHash of a text's word shingles, repeats included: a bit is set if over half of the hashes have it."""
    return majority(shingle_hashes(text, width))


def with_fingerprints(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), width: int = 4) -> DataFrame:
    """``carry`` columns and ``fp``, the fingerprint's bits as a signed long. A null text is an empty one."""
    fields = [df.schema[c] for c in carry]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fp bigint"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(b, width) for b in text_bytes(batch.column(0))], np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], [*carry, "fp"])

    return map_batches(df.select(F.col(text_col).alias("__text"), *carry), run, schema)


def block_masks(blocks: int, radius: int) -> list[int]:
    """The bit masks of the tables: every combination of ``blocks - radius`` of the blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(each, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: 64 rows of words, bit j of word i of row b is bit b of fingerprint 64 * i + j."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").transpose(2, 0, 1)).view(np.uint64).reshape(BITS, -1)


def within(differ: np.ndarray, radius: int) -> np.ndarray:
    """The words of lanes whose distance is at most ``radius``.

    ``differ`` has 64 rows, the XORed planes. Carry-save counters hold every lane's distance in bit slices; a
    lane that passes the radius stays out. Every eight planes, words without a lane left are abandoned.
    """
    shape = differ.shape[1:]
    flat = differ.reshape(BITS, -1)
    out = np.zeros(flat.shape[1], np.uint64)
    at = np.arange(flat.shape[1])
    size = radius.bit_length()
    start = (1 << size) - 1 - radius  # counters start here, so that the first carry out of them means over the radius
    slices = [np.full(len(at), ALL if start >> i & 1 else np.uint64(0)) for i in range(size)]
    alive = np.full(len(at), ALL)
    for b in range(BITS):
        carry = flat[b] if len(at) == flat.shape[1] else flat[b][at]
        for i in range(size):
            carry, slices[i] = slices[i] & carry, slices[i] ^ carry
        alive = alive & ~carry
        if b % 8 == 7:
            keep = alive != 0
            if not keep.all():
                at, alive, slices = at[keep], alive[keep], [s[keep] for s in slices]
                if not len(at):
                    break
    out[at] = alive
    return out.reshape(shape)


class Forest:
    """Union-find over the rows of a task."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def lanes(words: np.ndarray) -> np.ndarray:
    """The numbers of the lanes that are set in a row of words."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def shifted_pairs(fps: np.ndarray, size_left: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows i and i + s of the same bucket, for s = 1, 2, ...; ``size_left``: rows of the bucket after each row."""
    at = np.flatnonzero(size_left > 0)
    shift = 1
    while len(at):
        differ = planes_of(fps[at]) ^ planes_of(fps[at + shift])
        found = lanes(within(differ, radius))
        found = found[found < len(at)]
        yield at[found], at[found] + shift
        shift += 1
        at = at[size_left[at] >= shift]


def block_pairs(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within a large bucket, or between two parts of one: each row's bits against all planes, 32 rows at a time."""
    planes = planes_of(a if b is None else b)
    n = len(a if b is None else b)
    for start in range(0, len(a), 32):
        own = a[start : start + 32]
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(bool)
        first = start // 64 if b is None else 0
        found = lanes(np.ascontiguousarray(within(planes[:, None, first:] ^ np.where(bits, ALL, np.uint64(0))[:, :, None], radius)).reshape(-1))
        width = (planes.shape[1] - first) * 64
        i, j = found // width + start, found % width + first * 64
        ok = (j < n) & (j > i) if b is None else j < n
        yield i[ok], j[ok]


def bucket_pairs(key: np.ndarray, part: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """All links of a task's buckets, as (whether of small buckets, rows, rows); small buckets come first. Rows are sorted by key, part and side."""
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(key)))
    whole = side == 0
    left = np.repeat(starts + sizes, sizes) - 1 - np.arange(len(key))
    small = np.repeat((sizes <= SHIFTED) & np.logical_and.reduceat(whole, starts), sizes)
    for i, j in shifted_pairs(fps, np.where(small, left, 0), radius):
        if len(i):
            yield True, i, j
    for s, n in zip(starts.tolist(), sizes.tolist()):
        if small[s]:
            continue
        sides, own = side[s : s + n], fps[s : s + n]
        if sides[0] == 0:
            pairs, base = block_pairs(own, None, radius), s
        else:
            cut = int(np.searchsorted(sides, 2))
            pairs, base = block_pairs(own[:cut], own[cut:], radius), s + cut
        for i, j in pairs:
            yield False, i + s, j + base


def task_links(key: np.ndarray, part: np.ndarray, side: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int, fits: Fits | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The links of a task's buckets that join two trees, as numbers of ``ids``. Rows are sorted by key, part and side; links that do not fit are none."""
    values, node = np.unique(ids, return_inverse=True)
    forest, out = Forest(len(values)), []

    def enter(i: np.ndarray, j: np.ndarray) -> None:
        # a large group has far more links than rows: those inside a tree go before the loop
        nodes, at = np.unique(np.concatenate((node[i], node[j])), return_inverse=True)
        roots = np.array([forest.root(n) for n in nodes.tolist()], np.int64)[at]
        apart = roots[: len(i)] != roots[len(i) :]
        i, j = i[apart], j[apart]
        nearest = np.argsort(np.bitwise_count(fps[i] ^ fps[j]), kind="stable")  # what joins two trees is their nearest link
        for x, y in zip(node[i[nearest]].tolist(), node[j[nearest]].tolist()):
            if forest.join(x, y):
                out.append((x, y))

    side_by_side = []
    for small, i, j in bucket_pairs(key, part, side, fps, radius):
        if fits:
            fit = fits(i, j)
            i, j = i[fit], j[fit]
        if small:
            side_by_side.append((i, j))
            continue
        if side_by_side:
            enter(*(np.concatenate(x) for x in zip(*side_by_side)))
            side_by_side = []
        enter(i, j)
    if side_by_side:
        enter(*(np.concatenate(x) for x in zip(*side_by_side)))
    a = np.array([x for x, _ in out], np.int64)
    b = np.array([y for _, y in out], np.int64)
    return values[a], values[b]


def crossing_links(key: np.ndarray, part: np.ndarray, side: np.ndarray, fps: np.ndarray, ids: np.ndarray, tree: np.ndarray, radius: int, fits: Fits | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links of a task's buckets between rows of different trees, some at a time, as numbers of ``ids``. Rows are sorted by key, part and side."""
    for _, i, j in bucket_pairs(key, part, side, fps, radius):
        apart = tree[i] != tree[j]
        if fits:
            apart &= fits(i, j)
        if apart.any():
            a, b = ids[i[apart]], ids[j[apart]]
            yield tuple(np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1))


def deal(rows: DataFrame, bucket_part: int = BUCKET_PART, several: str | None = None) -> DataFrame:
    """Rows (key, id, fp and others) dealt by bucket, as key, part, side, fp, id and the others, sorted by the first three.

    Buckets over ``bucket_part`` rows are cut into parts by a hash, and each pair of parts is a bucket of its own, so a
    task never holds more than two parts; every pair of the bucket still meets. Buckets of one row are dropped before they
    are dealt, and so are those in which all rows are alike in column ``several``.
    """
    others = [c for c in rows.columns if c not in ("key", "id", "fp")]
    apart = [(F.min(several) != F.max(several)).alias("apart")] if several else []
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), *apart).where("n > 1 AND apart" if several else "n > 1").select("key", "n")
    parts = F.ceil(F.col("n") / F.lit(bucket_part)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int")
    dealt = rows.withColumnsRenamed({c: f"__{c}" for c in others}).join(sizes, "key").withColumn("parts", parts).withColumn("own", own)
    # part p meets part q as bucket min * parts + max; side 0: a part with itself, 1 and 2: the smaller and the larger part
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct(
            (F.least(F.col("own"), q) * F.col("parts") + F.greatest(F.col("own"), q)).alias("part"),
            F.when(F.col("own") == q, 0).when(F.col("own") < q, 1).otherwise(2).alias("side"),
        ),
    )
    dealt = dealt.select("key", "fp", "id", *(f"__{c}" for c in others), F.explode(pairs).alias("p")).select("key", F.col("p.part").alias("part"), F.col("p.side").alias("side"), "fp", "id", *(F.col(f"__{c}").alias(c) for c in others))
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "side", "fp")


def bucket_links(rows: DataFrame, find: Callable[[dict[str, np.ndarray]], Iterable[tuple[np.ndarray, np.ndarray]]], bucket_part: int = BUCKET_PART, several: str | None = None) -> DataFrame:
    """Links (a, b) that ``find`` gives for whole buckets of ``rows`` (see ``deal``); it gets the columns as arrays."""
    dealt = deal(rows, bucket_part, several)
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(k: np.ndarray) -> Iterator[pa.RecordBatch]:
            own = dict(zip(names, k)) | {"fp": k[3].view(np.uint64)}
            for a, b in find(own):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(h.shape[1] for h in held) < 200_000:
                continue
            k = np.concatenate(held, axis=1)
            last = np.flatnonzero((k[0] != k[0, -1]) | (k[1] != k[1, -1]))
            if len(last):  # all buckets but the last are complete
                yield from links(k[:, : last[-1] + 1])
                held = [k[:, last[-1] + 1 :]]
            else:
                held = [k]
        if held:
            yield from links(np.concatenate(held, axis=1))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_links(fps: DataFrame, radius: int = 4, blocks: int = 6, bucket_part: int = BUCKET_PART) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column ``fp``) within ``radius`` bits. Every fingerprint goes to one bucket of each table."""
    tables = F.array(*(F.lit(signed(m)) for m in block_masks(blocks, radius)))
    rows = fps.select("fp", F.posexplode(tables).alias("t", "mask")).select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), F.col("fp").alias("id"), "fp")
    return bucket_links(rows, lambda r: [task_links(r["key"], r["part"], r["side"], r["fp"], r["id"], radius)], bucket_part)


def components(links: DataFrame, label: str = "components", rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node that can be reached.

    Large-star and small-star rounds until nothing changes: stars are joined by their smallest member, and every
    round is written to the shared folder, where it replaces the one before. The minimum of a star is summed up before the shuffle.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v")))

    def summed(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = summed(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        done, edges = edges, staged(small(large(edges).where("u > v").distinct()).where("u > v").distinct(), label)
        unstaged(done)
        now = summed(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    Rows link if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest id that can
    be reached, the row's own included. A null text is an empty one and has fingerprint zero; a null id
    takes part and gets its component's smallest id (null if there is none); repeated rows are repeated.
    """
    marked = staged(with_fingerprints(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width=width), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = components(near_links(distinct.select("fp"), radius, blocks))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(firsts, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash components of all documents."""
    return simhash_components(table(spark, sf_dir, "documents"))
