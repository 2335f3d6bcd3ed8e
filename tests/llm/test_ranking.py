from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from tessitura.llm import ranking

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) by the definition; the texts of an item_id are ranked each for itself."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    many, total = len(own), sum(sum(c.values()) for _, c in own)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * many // total
            score = 0
            for t, times in Counter(terms(text)).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * many + 2) / (2 * sum(t in d for _, d in own) + 1)))
                    score += times * w * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def made(rng, n, words):
    """Texts over a vocabulary with very frequent and very rare words, with copies, so that scores tie."""
    rows = []
    for _ in range(n):
        text = " ".join(f"W{int(words ** rng.random())}" for _ in range(rng.choice([1, 3, 20, 200])))
        rows += [text] * rng.choice([1, 1, 1, 3])
    ids = rng.sample(range(10 * len(rows)), len(rows))
    return list(zip(ids, rows))


def found(spark, docs, items, **how):
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, n int, version int, terms string").repartition(3)
    out = ranking.ranked(df, spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, rank int"), **how)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out.collect()), key=str)


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True), (3, True)])
def test_equals_brute_force(spark, monkeypatch, seed, small):
    if small:  # many blocks, steps and pieces of a text
        for name, value in {"BLOCK_POSTINGS": 300, "STEP": 3, "FEW": 5, "AT_ONCE": 7}.items():
            monkeypatch.setattr(ranking, name, value)
    rng = random.Random(seed)
    docs = made(rng, 150, 300)
    items = [(i, " ".join(f"w{int(300 ** rng.random())}" for _ in range(rng.choice([1, 2, 8, 40])))) for i in range(20)]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items[:8], k=3, item_bytes=60) == brute(docs, items[:8], 3)


def test_stops_before_the_end_and_completes(monkeypatch):
    monkeypatch.setattr(ranking, "STEP", 50)
    rng = np.random.default_rng(4)
    n, vocabulary = 5000, 40
    lists = [np.flatnonzero(rng.random(vocabulary) < 1 / (1 + np.arange(vocabulary))) for _ in range(n)]
    offsets = np.append(0, np.cumsum([len(x) for x in lists]))
    own = np.concatenate(lists)
    impacts = rng.integers(1, 50, len(own)) * 1000
    block = ranking.Block(np.arange(n), np.zeros(n, bool), offsets, own, impacts, vocabulary)
    asked, weights = np.array([0, 1, 5, 30, 39]), np.array([1, 2, 30, 400, 900])
    weight = np.zeros(vocabulary, np.int64)
    weight[asked] = weights
    whole = np.array([(weight[own[a:b]] * impacts[a:b]).sum() for a, b in zip(offsets, offsets[1:])])
    added = []
    real = np.add.at
    monkeypatch.setattr(np, "add", type("Add", (), {"at": staticmethod(lambda a, i, v: (added.append(len(i)), real(a, i, v)))}))
    docs, scores = block.best(asked, weights, 20, 0)
    assert (scores == whole[docs]).all() and set(np.argsort(-whole, kind="stable")[:20]) <= set(docs.tolist())
    assert 0 < sum(added) < np.isin(own, asked).sum() / 2 and not block.sums.any()
    docs, scores = block.best(asked, weights, 20, int(np.sort(whole)[-5]))
    assert set(docs.tolist()) >= set(np.flatnonzero(whole >= np.sort(whole)[-5]).tolist())
    assert len(block.best(asked, weights, 20, 10**9)[0]) == 0


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "!!"), (None, "a b"), (None, "a b"), (4, "A\x00b"), (4, "a b"), (5, "É é a"), (6, "x " * 3000000 + "a"), (7, "b" * 100000)]
    items = [(1, "a"), (1, "b"), (2, None), (3, "?"), (4, "É"), (5, "a a b"), (5, "a a b"), (6, "nothing"), (None, "b")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_one_document_per_rank(spark):
    docs = [(i, "same text here") for i in range(50)]
    assert found(spark, docs, [(1, "same here")]) == brute(docs, [(1, "same here")])
