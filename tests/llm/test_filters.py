from __future__ import annotations

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tessitura.llm import filters

SCHEMA = "doc_id long, text string, source string, mask int, points int, `class` string"


def brute_masks(rows):
    """(doc_id, part, mask) of rows (doc_id, text, source), by the definition."""
    ids = {}
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))
    out = []
    for i, t, source in rows:
        t = t or ""
        words = t.encode().split()
        first = ids.get(t)
        fails = [
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t),
            first is not None and (i is None or first < i),
        ]
        out.append((i, source or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


def brute_audit(marked):
    """Every order applied document by document to (part, mask, good, toxic)."""
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {m[0] for m in marked}:
            left = [m for m in marked if m[0] == part]
            everything = left
            for step, c in enumerate(order, 1):
                bit = 1 << "ABCDE".index(c)
                gone = [m for m in left if m[1] & bit]
                redundant = sum(1 for m in everything if m[1] & bit) - len(gone)
                left = [m for m in left if not m[1] & bit]
                alone = sum(m[1] == bit for m in everything)
                out[part, order, step] = (len(left), len(gone), redundant, alone, sum(m[2] for m in gone), sum(m[3] for m in gone))
                shapley[part, c] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def made(rng, n):
    """Texts that fail all kinds of filters, with copies, texts that differ in one late letter only, and texts of one length."""
    rows = []
    for _ in range(n):
        kind = rng.randrange(6)
        words = [rng.choice("abcdefghij") * rng.randrange(1, 4) + str(rng.randrange(400 if kind != 1 else 3)) for _ in range(rng.randrange(30, 400))]
        if kind == 2:
            words = [w.upper() for w in words]
        if kind == 3:
            words[1] += rng.choice("#$%&*|é")
        text = " ".join(words)
        rows.append(text)
        if kind == 4:
            rows += [text] * rng.randrange(1, 4)
        if kind == 5:
            rows += [text[:-1] + "Z", text[:-1] + "ß", text[:-1] + "z"]
    ids = rng.sample(range(10 * len(rows)), len(rows))
    return [(i, t, rng.choice(["s", "t", None])) for i, t in zip(ids, rows)]


def found(spark, rows):
    extra = [(*r, 7, 7, "x") for r in rows]
    return sorted(map(tuple, filters.filter_masks(spark.createDataFrame(extra, SCHEMA).repartition(5)).collect()), key=str)


@pytest.mark.parametrize("block", [1, 16, 256])
def test_masks_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(filters, "BLOCK", block)
    monkeypatch.setattr(filters.block_hashes, "__defaults__", (block,))
    rows = made(random.Random(block), 60)
    want = sorted(brute_masks(rows), key=str)
    assert sum(m[2] >> 4 for m in want) > 10
    assert found(spark, rows) == want


def test_edges(spark):
    long = "Word " * 60000
    rows = [
        (5, None, "a"), (3, "", "a"), (9, "\t \n", None), (None, "copy", "a"), (7, "copy", "b"), (None, "alone", "a"), (None, "alone", "a"), (8, "twice", ""),
        (8, "twice", ""), (8, "other", "a"), (1, long, "a"), (2, long, "a"), (4, long + ".", "a"), (6, "é" * 100, "a"), (10, "ab" * 50, "a"), (11, "a\x1cb\x85c d", "a"),
    ]
    assert found(spark, rows) == sorted(brute_masks(rows), key=str)
    assert filters.filter_masks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_blocks_are_no_proof(spark):
    """Texts that meet in one class with the same hashes are told by their letters."""
    rows = [(4, "x", 1), (2, "x", 1), (3, "y", 1), (5, "y", 1), (1, "x", 2)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, `class` long")
    assert sorted(map(tuple, filters.first_of_texts(texts).collect())) == [(1, 2), (1, 3), (2, 1)]


def test_texts_are_shuffled_where_classes_are_many(spark, monkeypatch):
    monkeypatch.setattr(filters, "BROADCAST_CLASSES", 0)
    rows = made(random.Random(9), 40)
    assert found(spark, rows) == sorted(brute_masks(rows), key=str)


def test_audit_equals_every_order(spark):
    rng = random.Random(3)
    marked = [(rng.choice("ab"), rng.choice([0, 0, 1, 3, 4, 9, 16, 17, 24, 31]), rng.random() < 0.5, rng.random() < 0.2) for _ in range(300)] + [("c", 0, True, False)]
    rows = filters.audit(spark.createDataFrame(marked, "part string, mask int, good boolean, toxic boolean")).collect()
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows}
    assert len(rows) == 3 * 600 and got == brute_audit(marked)


def test_labels(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (None, "c", "s"), (3, "d", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    row = filters.filter_audit(docs, labels).where(F.col("filter_order") == "ABCDE").where("step = 1").first()
    assert (row["removed"], row["good_lost"], row["toxic_lost"]) == (4, 1, 2)
    assert filters.filter_audit(docs.where("false"), labels).count() == 0
