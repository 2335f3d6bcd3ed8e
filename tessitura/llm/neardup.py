"""Near-duplicates by the similarity of their word shingles, found by SimHash and verified on whole texts.

SimHash alone can't promise a similarity: at 0.8, fingerprints differ in 10 of 64 bits on average and in 20 at times. So the buckets in which
fingerprints are compared come from shingles, by a rule that loses nothing, and the radius is so wide that it spares work only.

1. A text becomes the sorted set of its shingles' hashes, and a fingerprint of that set. Equal sets are one *node*.
2. Shingles are counted over all nodes. Their order is by count, then by hash. Counts are held in two tables of fixed size; where
   different shingles meet in them the order changes, but it stays one order for all nodes, which is all that step 3 needs.
3. Of n shingles, the first ``n - ceil(similarity * n) + 1`` are the node's keys: two sets that are similar enough share at least one key.
   Keys that no other node has are left out, so a text with a fifth of its shingles to itself has none.
4. Buckets with the same members are one. Within a bucket, fingerprints are compared in bit slices, and the nearest links that connect it are
   verified on the sets. Verified links make trees.
5. Nodes of different trees that share a bucket are compared again, so that a link that failed hides none: in small buckets the pairs whose fingerprints are near,
   each verified on its sets. Large buckets (pages of one template, say, that are alike but not enough) would make all pairs many times over. They are merged into *blocks*, whose nodes come
   together with their sets once for each pair of parts, and all pairs of a block are counted there at once by products of membership matrices. Only links that join two trees leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import bit_map, has_bits, map_batches, staged, text_bytes, unstaged
from tessitura.llm.simhash import Forest, bucket_links, components, crossing_links, majority, shingle_hashes, task_links

#: Most bits of the map of shared shingles and of first rows. The table of counts has a sixteenth as many bytes.
MAP_BITS = 27
#: Bits in which fingerprints of similar texts may differ. At similarity 0.8 the mean is 10 and the deviation 3 (small sets: 12 and 3).
RADIUS = 26
#: A shingle in this many nodes has its count in the table of counts; of rarer ones only whether they are shared is held.
COUNTED = 4
#: Shingles that a task holds while it counts.
COUNTED_AT_ONCE = 1 << 19
#: Nodes of a bucket beyond which it is compared as part of a block.
LARGE = 64
#: Most nodes and shingles of a part of a block; a task holds two parts.
PART_NODES, PART_SHINGLES = 512, 1 << 20
#: Shingles that so many nodes of a part have are counted by matrix products, rarer ones pair by pair.
DENSE = 32
#: Rows (of some 50 bytes) up to which a table of nodes is broadcast.
BROADCAST_ROWS = 500_000


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The sorted hashes of a text's word shingles; a text without words has one of its own."""
    found = np.unique(np.concatenate(list(shingle_hashes(text, width))))
    return found if len(found) else np.zeros(1, np.uint64)


def key_count(n: int, similarity: float) -> int:
    """How many shingles of n are keys."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``similarity``."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of some sets have in common, as a square matrix; the diagonal is not counted."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)  # exact up to 2 ** 24
    order = np.argsort(at, kind="stable")
    owner, starts = owner[order], np.cumsum(counts) - counts
    for c in range(2, min(DENSE, n) + 1):  # elements of c sets: one step for each two of their places
        own = starts[counts == c]
        if len(own):
            rows = owner[own[:, None] + np.arange(c)]
            for i in range(c):
                for j in range(i + 1, c):
                    np.add.at(out, (rows[:, i], rows[:, j]), 1)
    out += out.T
    dense = np.flatnonzero(counts > DENSE)
    for a in range(0, len(dense), 2048):
        some = dense[a : a + 2048]
        member = np.zeros((n, len(some)), np.float32)
        for column, k in enumerate(some.tolist()):
            member[owner[starts[k] : starts[k] + counts[k]], column] = 1
        out += member @ member.T
    return out


def part_links(ids: np.ndarray, trees: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join trees, among all pairs of a part (``sides`` 0) or between two parts (1 and 2), that are as similar as asked. One link for two trees is enough."""
    if len(ids) < 2:
        return ids[:0], ids[:0]
    size = np.array([len(x) for x in sets], np.float64)
    common = common_counts(sets)
    values, tree = np.unique(trees, return_inverse=True)
    forest, out, after = Forest(len(values)), [], np.arange(len(ids))
    for i in range(len(ids)):  # a row at a time, so that a part needs little more than its matrix
        both = common[i].astype(np.float64)
        near = (both >= similarity * (size[i] + size - both) - 1e-9) & (trees != trees[i]) & ((sides > sides[i]) | ((sides == 0) & (after > i)))
        for j in np.flatnonzero(near).tolist():
            if forest.join(int(tree[i]), int(tree[j])):
                out.append((i, j))
    a, b = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
    return ids[a], ids[b]


def block_links(blocks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between trees of rows (block, node, tree, n), with the sets (node, shingles) of all of them.

    A block is dealt into parts by a hash, so that no task holds more than two parts; every pair of its nodes meets in one task.
    """
    sizes = blocks.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / F.lit(PART_NODES)), F.ceil(F.sum("n") / F.lit(PART_SHINGLES))).cast("int").alias("parts"), (F.min("tree") != F.max("tree")).alias("apart"))
    dealt = blocks.join(sizes.where("apart").drop("apart"), "block").withColumn("own", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct((F.least(F.col("own"), q) * F.col("parts") + F.greatest(F.col("own"), q)).alias("part"), F.when(F.col("own") == q, 0).when(F.col("own") < q, 1).otherwise(2).alias("side")),
    )
    rows = dealt.join(sets, "node").select("block", "node", "tree", "shingles", F.explode(pairs).alias("p")).select("block", F.col("p.part").alias("part"), F.col("p.side").alias("side"), "node", "tree", "shingles")
    rows = rows.repartition("block", "part").sortWithinPartitions("block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links() -> pa.RecordBatch:
            sides, ids, trees = (np.array([h[k] for h in held], np.int64) for k in (2, 3, 4))
            a, b = part_links(ids, trees, sides, [np.frombuffer(h[5], np.uint64) for h in held], similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    yield links()
                    held = []
                held.append(row)
        if held:
            yield links()

    return rows.mapInArrow(run, "a bigint, b bigint")


def described(base: DataFrame, width: int) -> DataFrame:
    """doc_id, version, own and, of the text's shingle set, n (its size) and digest."""
    fields = [base.schema[c] for c in ("doc_id", "version", "own")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(b, width) for b in text_bytes(batch.column(3))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(digest_of, sets)), pa.binary())], ["doc_id", "version", "own", "n", "digest"])

    return map_batches(base.select("doc_id", "version", "own", "text"), run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", n bigint, digest binary", rows=256)


def digest_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sets_of(batch: pa.RecordBatch, firsts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sets of those rows of a batch (own, text) that may be the first of their set; a chance bit of the map lets a later copy pass."""
    texts = text_bytes(batch.column(1))
    for i in np.flatnonzero(has_bits(firsts, batch.column(0).to_numpy())).tolist():
        yield shingle_set(texts[i], width)


def counted(base: DataFrame, firsts: np.ndarray, width: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit map of the shingles that several nodes have, and a table of the logarithms of their counts where there are ``COUNTED`` or more.

    ``total`` shingles are dealt by their top bits as packed arrays, of which a task sums up some millions; each part gives its
    slice of the tables, so the driver gets tables of fixed size and no shingle.
    """
    spark = base.sparkSession
    bits = min(MAP_BITS, max(16, (8 * total).bit_length()))
    size = bits - 4
    cut = min(size, max(4, (total >> 20).bit_length()))
    maps = spark.sparkContext.broadcast(firsts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            part = (values >> np.uint64(64 - cut)).astype(np.int64)
            low = (values >> np.uint64(32 - cut) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            rows = [(int(part[a]), low[a:b][n[a:b] == 1].tobytes(), low[a:b][n[a:b] > 1].tobytes(), n[a:b][n[a:b] > 1].astype(np.uint32).tobytes()) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)])]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i in range(4)], ["part", "once", "more", "counts"])

        for batch in batches:
            held += sets_of(batch, maps.value, width)
            if sum(map(len, held)) >= COUNTED_AT_ONCE:
                yield out()
                held = []
        if held:
            yield out()

    def slices(part: int, once: list[bytes], more: list[bytes], counts: list[bytes]) -> tuple[int, bytes, bytes]:
        low = np.concatenate([np.frombuffer(b"".join(x), np.uint32) for x in (once, more)])
        n = np.concatenate((np.ones(sum(map(len, once)) // 4, np.int64), np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)))
        order = np.argsort(low)
        low, n = low[order], n[order]
        starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        low, n = low[starts], np.add.reduceat(n, starts)
        shared = np.zeros(1 << (bits - cut), np.uint8)
        shared[low[n > 1] >> np.uint32(32 - (bits - cut))] = 1
        level = np.zeros(1 << (size - cut), np.uint8)
        many = np.flatnonzero(n >= COUNTED)
        many = many[np.argsort(n[many])]  # of those that meet in a place, the largest is put there last
        level[low[many] >> np.uint32(32 - (size - cut)) if size > cut else np.zeros(len(many), np.int64)] = np.log2(n[many]).astype(np.uint8)
        return part, np.packbits(shared, bitorder="little").tobytes(), level.tobytes()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, ([], [], [])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if i else pa.int64()) for i, x in enumerate(slices(part, *held))], ["part", "shared", "level"])

        for batch in batches:
            for p, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if part is not None and p != part:
                    yield out()
                    held = ([], [], [])
                part = p
                for to, blob in zip(held, blobs):
                    to.append(blob)
        if part is not None:
            yield out()

    dealt = base.select("own", "text").mapInArrow(packed, "part bigint, once binary, more binary, counts binary").repartition("part").sortWithinPartitions("part")
    found = dealt.mapInArrow(summed, "part bigint, shared binary, level binary").toArrow()
    shared, level = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << size, np.uint8)
    for p, own, logs in zip(*(found.column(c).to_pylist() for c in ("part", "shared", "level"))):
        shared[p * len(own) : (p + 1) * len(own)] = np.frombuffer(own, np.uint8)
        level[p * len(logs) : (p + 1) * len(logs)] = np.frombuffer(logs, np.uint8)
    return shared.view(np.uint64), level


def keys_of(base: DataFrame, firsts: np.ndarray, tables: tuple[np.ndarray, np.ndarray], width: int, similarity: float) -> DataFrame:
    """Rows (key, digest, fp, n): each node's keys, but for those that no other node has."""
    maps = base.sparkSession.sparkContext.broadcast((firsts, *tables))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        own, shared, level = maps.value
        shift = np.uint64(64 - (len(level).bit_length() - 1))
        rows, keys = [], []
        for found in sets_of(batch, own, width):
            several = has_bits(shared, found)
            most = key_count(len(found), similarity)
            if len(found) - np.count_nonzero(several) >= most:
                continue
            order = np.argsort(np.where(several, level[found >> shift] + np.uint8(1), np.uint8(0)), kind="stable")[:most]
            keys.append(found[order[several[order]]])
            rows += [(digest_of(found), majority([found]) - (1 << 63), len(found))] * len(keys[-1])
        if not rows:
            return None
        digests, fps, sizes = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64())], ["key", "digest", "fp", "n"])

    return map_batches(base.select("own", "text"), run, "key bigint, digest binary, fp bigint, n bigint", rows=256)


def packed_sets(base: DataFrame, width: int) -> DataFrame:
    """node, digest and shingles (the set's bytes) of rows node and text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(b, width) for b in text_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(digest_of, sets)), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "digest", "shingles"])

    return map_batches(base.select("node", "text"), run, "node bigint, digest binary, shingles binary", rows=256)


def similar_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id, version (a hash of the text), component_id and root (the component's own number) of every row: rows link if their texts' shingle sets have at least the asked Jaccard similarity.

    All links are verified, and no pair that is similar is left apart but by a fingerprint over ``radius`` bits away (5 deviations;
    4 in sets below ten shingles) or by hashes of shingles that collide. ``component_id`` is the smallest id that can
    be reached. A null text is an empty one, and texts without words are alike; a null id takes part and gets its component's smallest id
    (null if there is none); repeated rows are repeated; rows of one id with different texts are different nodes.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"), F.col(text_col).alias("text"))
    base = base.withColumn("own", F.xxhash64("version", F.col("doc_id").isNull(), "doc_id"))
    rows = staged(described(base, width), "described")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "version", "own"))
    seed = 0
    while True:  # nodes are numbers of 64 bits; should two sets share one, all are numbered anew
        node = F.xxhash64("digest", F.lit(seed)).alias("node")
        nodes = rows.groupBy("digest").agg(first.alias("first"), F.first("n").alias("n"))
        nodes = staged(nodes.select(node, F.col("first.doc_id").alias("first_id"), F.col("first.own").alias("own"), "n"), "nodes")
        if not nodes.groupBy("node").count().where("count > 1").limit(1).count():
            break
        seed += 1
    many, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    firsts = bit_map(nodes, "own", min(MAP_BITS, max(10, (16 * many).bit_length())))
    keys = keys_of(base, firsts, counted(base, firsts, width, total), width, similarity)
    keys = staged(keys.select("key", node.alias("id"), "fp", "n"), "keys")
    # of buckets with the same members one is enough: most of a text's keys lead to the same others
    alike = keys.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit("again"))).alias("y")).where("size > 1")
    chosen = alike.groupBy("size", "x", "y").agg(F.min("key").alias("key"))
    every, keys = keys, staged(keys.join(chosen.select("key", "size"), "key"), "buckets")
    unstaged(every)

    def fits(own: dict[str, np.ndarray]):
        n = own["n"]
        return lambda i, j: (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9) & (own["id"][i] != own["id"][j])

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sets_for(asked: DataFrame) -> DataFrame:
        """node and shingles of distinct nodes, from the texts."""
        own = staged(nodes.select("node", "own").join(asked, "node", "left_semi"), "asked")
        texts = base.join(F.broadcast(own) if own.count() <= BROADCAST_ROWS else own, "own").select("node", "text").dropDuplicates(["node"])
        out = staged(packed_sets(texts, width).where(F.col("node") == node).select("node", "shingles"), "sets")
        unstaged(own)
        return out

    def verified(links: DataFrame, label: str) -> DataFrame:
        sets = sets_for(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct())
        both = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        out = staged(map_batches(both.select("a", "b", "sa", "sb"), verify, "a bigint, b bigint", rows=256), label)
        unstaged(sets)
        return out

    nearest = bucket_links(keys.drop("size"), lambda r: [task_links(r["key"], r["part"], r["side"], r["fp"], r["id"], radius, fits(r))])
    links = staged(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    trees = staged(components(verified(links, "verified")), "trees")
    told = keys.join(trees.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "fp", "n", "size", F.coalesce("root", "id").alias("tree"))
    apart = bucket_links(told.where(F.col("size") <= LARGE).drop("size"), lambda r: crossing_links(r["key"], r["part"], r["side"], r["fp"], r["id"], r["tree"], radius, fits(r)), several="tree")
    more = staged(apart.distinct().join(links, ["a", "b"], "left_anti"), "crossing")
    large = staged(told.where(F.col("size") > LARGE).select("key", "id", "n", "tree"), "large")
    open_keys = large.groupBy("key").agg(F.min("id").alias("first"), (F.min("tree") != F.max("tree")).alias("apart")).where("apart").select("key", "first")
    member = large.join(open_keys, "key").select("id", "n", "tree", "first")
    stars = components(member.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), "blocks")
    blocks = staged(member.select(F.col("id").alias("node"), "tree", "n").distinct().join(stars, "node").select(F.col("root").alias("block"), "node", "tree", "n"), "blocks")
    sets = sets_for(blocks.select("node"))
    across = staged(block_links(blocks, sets, similarity), "across")
    unstaged(keys, links, large, blocks, sets)
    joined = trees.select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = components(joined.unionByName(verified(more, "verified")).unionByName(across))
    rooted = nodes.join(found, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "version", node).join(rooted.join(smallest, "root").select("node", "component_id", "root"), "node").select("doc_id", "version", "component_id", "root")
