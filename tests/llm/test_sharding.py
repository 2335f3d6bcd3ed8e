from __future__ import annotations

import hashlib
import math
import zlib

from pyspark.sql import functions as F

from tessitura.llm.sharding import Tree, assign_shards


def test_law_key(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"), F.lit(1).alias("shard"))
    df = df.unionByName(spark.createDataFrame([(7, None, 1), (None, "a", 1), (None, "a", 1)], "doc_id long, text string, shard int"))
    rows = assign_shards(df, rows_per_slice=20).collect()
    assert len(rows) == 5003 and {r["law"] for r in rows} == {"key"}
    by: dict[int, list[int]] = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 2 * 5003 / 24
    one = next(r for r in rows if r["doc_id"] == 49)
    text = "é" + "x" * 49
    assert (one["size"], one["text_crc32"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1
    null = next(r for r in rows if r["doc_id"] == 7 and r["size"] == 8)
    assert null["text_crc32"] == 0
    assert assign_shards(df.limit(0)).count() == 0


def test_weights_follow_the_shards():
    regions, racks, shards = Tree(25).children()
    assert regions == [(0, 8), (1, 8), (2, 8), (3, 1)] and racks[3] == [(12, 1)] and shards[12] == [(24, 1)]


def brute_shard(key, shards):
    """Down a plain tree: at each level the child with the smallest weighted draw."""
    def pick(level, children):
        if len(children) == 1:
            return next(iter(children))
        drawn = {n: -math.log((int(hashlib.md5(f"{level}{n}:{key}".encode()).hexdigest()[:13], 16) + 1) / (2**52 + 1)) / w for n, w in children.items()}
        return min(sorted(children), key=drawn.get)

    leaves = [(s // 8, s // 2, s) for s in range(shards)]
    region = pick("region", {r: sum(x[0] == r for x in leaves) for r, _, _ in leaves})
    racks = {k: sum(x[1] == k for x in leaves) for r, k, _ in leaves if r == region}
    rack = pick("rack", racks)
    return pick("shard", {s: 1 for _, k, s in leaves if k == rack})


def test_shards_equal_brute_force(spark):
    df = spark.range(0, 40_000, 13).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for r in assign_shards(df).collect():
        assert (r["shard"], r["grown_shard"]) == (brute_shard(r["doc_id"], 24), brute_shard(r["doc_id"], 25))


def test_rows_without_a_key_are_spread(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = assign_shards(df, rows_per_slice=10).collect()
    assert len({r["shard"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == list(range(3000))
