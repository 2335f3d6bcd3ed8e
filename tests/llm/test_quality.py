from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tessitura.llm import quality


def brute_features(text):
    """What text_features counts, letter by letter and word by word."""
    raw = (text or "").encode()
    points = max(1, len(text or ""))
    words = raw.replace(b"\t", b" ").replace(b"\n", b" ").split(b" ")
    words = [w for w in words if w]
    share = lambda these: sum(c in these for c in text or "") / points
    shares = [share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(".,;:?"), share("!\"'()-/[]"), share("#$%&*+<=>@\\^_`{|}~"), sum(c >= "\x80" for c in text or "") / points]
    if not words:
        return [0.0] * 10 + shares
    n, counts, lines = len(words), Counter(words), raw.split(b"\n")
    return [
        np.log1p(n), sum(map(len, words)) / n, np.log1p(max(map(len, words))), sum(len(w) <= 3 for w in words) / n, len(counts) / n, counts.most_common(1)[0][1] / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, np.log1p(len(raw) / len(lines)), 1 - len(set(lines)) / len(lines), (raw.count(b". ") + raw.count(b".\n")) / n, *shares,
    ]


def test_features():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aAbé1 \n\t.!#|ß日") for _ in range(rng.randint(0, 60)))
        assert quality.text_features(text.encode()) == pytest.approx(brute_features(text))
    assert quality.text_features(None) == quality.text_features(b"") == [0.0] * len(quality.FEATURES)


def brute_tree(g, h, leaves):
    """The greedy tree of a table of one axis, by trying all cuts."""
    worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + quality.SHRINK)
    boxes = [(0, len(g))]
    while len(boxes) < leaves:
        cuts = [(worth(a, c) + worth(c, b) - worth(a, b), (a, c, b)) for a, b in boxes for c in range(a + 1, b) if min(h[a:c].sum(), h[c:b].sum()) >= quality.LEAST]
        if not cuts or max(cuts)[0] <= 1e-9:
            break
        a, c, b = max(cuts)[1]
        boxes.remove((a, b))
        boxes += [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in boxes:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + quality.SHRINK)
    return out


def test_trees():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n = int(rng.integers(1, 20))
        g, h = rng.normal(0, 5, n), rng.random(n) * 4
        assert np.allclose(quality.shallow_tree(g, h, 4), brute_tree(g, h, 4))
    g = np.array([[5.0, -5.0], [-5.0, 5.0]])
    assert (np.sign(quality.shallow_tree(g + [[0.1, 0], [0, 0]], np.full((2, 2), 9.0))) == np.sign(g)).all()


def test_edges_of_bins():
    assert quality.cut_edges(np.array([0, 0, 0, 1, 5], np.float32), 32).tolist() == [0.5, 3.0] and len(quality.cut_edges(np.zeros(9), 32)) == 0
    found = quality.cut_edges(np.arange(1000), 32)
    assert len(found) == 31 and set(np.bincount(np.searchsorted(found, np.arange(1000), "right"))) <= {31, 32}


def test_scores_are_sums_of_table_entries_and_pairs_learn_what_features_cannot():
    rng = np.random.default_rng(3)
    x = np.round(rng.random((4000, len(quality.FEATURES))), 1).astype(np.float32)
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality.fit(x, y, np.ones(len(y)))
    assert model.pairs[0] == (2, 5) and ((model.score(x) > 0.5) == y).mean() > 0.98
    for row in x[:50]:
        margin = model.base + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, model.edges, model.tables))
        at = [sum(v >= e for e in edges) for v, edges in zip(row, model.pair_edges)]
        margin += sum(t[at[f], at[g]] for (f, g), t in zip(model.pairs, model.pair_tables))
        assert model.margin(row[None])[0] == pytest.approx(margin)


def test_held_out_accuracy_and_independence(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    told = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect()]
    held = [r["predicted"] == q for r, q in told if r["held_out"]]
    assert len(held) > 60 and sum(held) / len(held) > 0.94
    # labels of the held-out fold, languages, sources and the order of rows change nothing
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic").repartition(7)
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source").repartition(5), other).collect()}
    assert again == {i: r["score"] for i, r in rows.items()}


def test_sample_is_bounded(spark):
    rows = [(i, f"word{i} " * (i % 90 + 1)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    seen = []
    real = quality.fit
    quality.fit = lambda x, y, n: (seen.append(len(y)), real(x, y, n))[1]
    try:
        quality.fit_quality(quality.with_features(docs), labels, sample=200)
    finally:
        quality.fit = real
    assert 100 < seen[0] < 300


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "some text", 3), (3, "x" * 2_000_000, 4), (3, "a b. " * 200_000, 4), (4, "###", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (77, 0)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    for some in (labels.where("false"), labels.where("quality = 1")):
        assert len({r["score"] for r in quality.quality_scores(docs, some).collect()}) == 1
    assert quality.quality_scores(docs.where("false"), labels).count() == 0


def test_every_pair_of_marks_counts_once():
    """No character stands in two of the sets, so that shares add up to at most one."""
    sets = [quality.CAPITALS, quality.DIGITS, quality.STOPS, quality.MARKS, quality.SYMBOLS]
    assert not any(set(a) & set(b) for (i, a), (j, b) in product(enumerate(sets), repeat=2) if i < j)
