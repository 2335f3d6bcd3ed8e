from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessitura.llm import simhash


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, width=4):
    """(fingerprint, smallest id reachable) by id."""
    fps = {i: brute_fingerprint(t, width) for i, t in rows}
    root = {f: f for f in fps.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = list(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    first = {}
    for i, f in fps.items():
        first[find(f)] = min(first.get(find(f), 1 << 60), i)
    return {i: (f"{f:016x}", first[find(f)]) for i, f in fps.items()}


@pytest.mark.parametrize("part", [3, 4096])
def test_crossing_links_are_all_between_trees(spark, part):
    rng = np.random.default_rng(6)
    f = sorted({int(0x1234567890ABCDEF ^ (1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 63, (60, 2))})
    rows = [(7, x, x, k % 3) for k, x in enumerate(f)]
    find = lambda r: simhash.crossing_links(r["key"], r["part"], r["side"], r["fp"], r["id"], r["own"], 3)
    links = simhash.bucket_links(spark.createDataFrame(rows, "key long, id long, fp long, own long"), find, part, several="own")
    want = {(a, b) for _, a, _, t in rows for _, b, _, u in rows if a < b and t != u and (a ^ b).bit_count() <= 3}
    assert {tuple(r) for r in links.collect()} == want


def test_fingerprint_is_xxhash64_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("é a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("é a b c".encode(), 42)
    for t in (None, "", " \t ", "One", "a b c d", "A b\x0bc d e É f", "w " * 70_000):
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


@pytest.mark.parametrize("n", [2, 70, 300, 3000])
def test_bit_slices_find_all_pairs(n):
    rng = np.random.default_rng(n)
    f = rng.integers(0, 2**63, n // 3 + 1, dtype=np.uint64)[rng.integers(0, n // 3 + 1, n)]
    for _ in range(5):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * rng.integers(0, 2, n).astype(np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4, 1))
    want = set(zip(i.tolist(), j.tolist()))
    assert {p for a, b in simhash.block_pairs(f, None, 4) for p in zip(a.tolist(), b.tolist())} == want
    h = n // 2
    assert {p for a, b in simhash.block_pairs(f[:h], f[h:], 4) for p in zip(a.tolist(), (b + h).tolist())} == {p for p in want if p[0] < h <= p[1]}
    if n < 400:
        assert {p for a, b in simhash.shifted_pairs(f, np.arange(n)[::-1].copy(), 4) for p in zip(a.tolist(), b.tolist())} == want


@pytest.mark.parametrize("part", [3, 4096])
def test_large_buckets_lose_no_link(spark, part):
    rng = np.random.default_rng(5)
    f = [int(x) for x in {int(0x1234567890ABCDEF ^ (1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 63, (60, 2))}]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in f], "fp long"), bucket_part=part)
    roots = {r["root"] for r in simhash.components(links).collect()}
    assert len(roots) == 1


def test_components_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_edges(spark):
    df = spark.createDataFrame([(3, None, 1), (2, "", 1), (2, "", 1), (None, "a b c d", 1), (9, "a  B c d", 1)], "doc_id long, text string, fp int")
    rows = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(df).collect())
    same = f"{brute_fingerprint('a b c d'):016x}"
    assert rows == sorted([("3", "0" * 16, 2), ("2", "0" * 16, 2), ("2", "0" * 16, 2), ("None", same, 9), ("9", same, 9)])
    assert simhash.simhash_components(df.limit(0)).count() == 0
