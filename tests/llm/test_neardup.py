from __future__ import annotations

import numpy as np
import pytest

from tessitura.llm import neardup


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_similar(rows, width, similarity):
    """The smallest id reachable over pairs as similar as asked, by id."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for a in ids:
        for b in {b for s in sets[a] for b in holders[s] if b < a}:
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def found(spark, rows, **how):
    return {r["doc_id"]: r["component_id"] for r in neardup.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **how).collect()}


def near_copies(rng, n, longest):
    """Texts and copies with some words changed, around a similarity of 0.8, many with a common passage."""
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(3, longest))]
        if rng.random() < 0.5:
            words[1:1] = passage
        rows.append(words)
        for _ in range(rng.integers(0, 4)):
            copy = list(words)
            for at in rng.choice(len(copy), min(len(copy), int(rng.integers(0, max(2, len(copy) // 25)))), replace=False):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            rows.append(copy)
    return [(int(i), " ".join(rows[k])) for i, k in zip(rng.permutation(len(rows)), range(len(rows)))]


@pytest.mark.parametrize(("seed", "longest"), [(1, 12), (2, 60), (3, 400)])
def test_equals_brute_force(spark, seed, longest):
    rows = near_copies(np.random.default_rng(seed), 120, longest)
    want = brute_similar(rows, 5, 0.8)
    assert sum(want[i] != i for i in want) > 20
    assert found(spark, rows) == want


def test_small_tables_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MAP_BITS", 16)
    monkeypatch.setattr(neardup, "COUNTED_AT_ONCE", 500)
    rows = near_copies(np.random.default_rng(4), 150, 300)
    assert found(spark, rows) == brute_similar(rows, 5, 0.8)


def test_common_lines_make_no_copies(spark):
    line = " ".join(f"b{i}" for i in range(12))
    rows = [(k, " ".join([line] * 400 + [f"t{k}x{i}" for i in range(100)])) for k in range(40)]
    assert found(spark, rows) == {k: k for k in range(40)}


def test_chains_and_failed_links(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(30):  # each text is like the next one only
        rows.append((k, " ".join(words)))
        for at in range(k * 6 % 190, k * 6 % 190 + 4):
            words[at] = f"c{k}x{at}"
    rows += [(100 + k, " ".join(f"w{i}" if i % 20 else f"d{k}x{i}" for i in range(200))) for k in range(30)]
    want = brute_similar(rows, 5, 0.8)
    assert found(spark, rows) == want and want[29] == 0


def test_data_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert found(spark, rows) == brute_similar(rows, 5, 0.8)


def test_edges(spark):
    odd = [(1, None), (2, ""), (4, "a b"), (4, "A  b"), (None, "a b"), (7, "a c")]
    got = neardup.similar_components(spark.createDataFrame([(*r, 3) for r in odd], "doc_id long, text string, node int"))
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got.collect()) == [("1", 1), ("2", 1), ("4", 4), ("4", 4), ("7", 7), ("None", 4)]
    assert neardup.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_counts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60 if k % 2 else 400, rng.integers(1, 90)).astype(np.uint64)) for k in range(80)]
    got = neardup.common_counts(sets)
    for i in range(80):
        assert [got[i, j] for j in range(80) if j != i] == [len(np.intersect1d(sets[i], sets[j])) for j in range(80) if j != i]


def template_pages(n, own, rng):
    """Pages of one template whose own words make them alike, but not enough; some have a near copy, and some a page between them and the next."""
    common = [f"c{i}" for i in range(300)]
    rows = []
    for k in range(n):
        words = common + [f"o{k}x{i}" for i in range(own)]
        rows.append(words)
        if k % 10 == 0:
            rows.append(words[:-2] + [f"y{k}", f"z{k}"])
    return [(int(i), " ".join(w)) for i, w in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize(("large", "part"), [(64, 1024), (8, 16)])
def test_templates_are_compared_in_blocks(spark, monkeypatch, large, part):
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "PART_NODES", part)
    rows = template_pages(150, 45, np.random.default_rng(6)) + [(10_000 + i, t) for i, t in near_copies(np.random.default_rng(7), 60, 200)]
    want = brute_similar(rows, 5, 0.8)
    assert found(spark, rows) == want and sum(want[i] != i for i in want) > 15


def test_one_group_of_uneven_copies(spark):
    """Copies of one text, each with other words of its own changed, from alike to not enough."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(240)]
    rows = []
    for k in range(220):
        copy = list(words)
        for at in rng.choice(240, int(rng.integers(1, 9)), replace=False):
            copy[at] = f"k{k}x{at}"
        rows.append((k, " ".join(copy)))
    assert found(spark, rows) == brute_similar(rows, 5, 0.8)
