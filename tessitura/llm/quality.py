"""Quality of documents by a generalised additive model with pairwise interactions.

A text becomes ``FEATURES``, shares and lengths that are counted over the whole of it. Each feature is cut into bins, and the model is one *table*
per feature and one per chosen pair of features: a score is the sum of one entry of each, taken by the text's bins, and a
logistic function makes it a probability. So what every feature does can be read off its table.

Tables are learned by cyclic boosting: feature after feature, again and again, a shallow tree is fitted over the bins to the gradient of the loss and its
leaves are added to that feature's table by a small rate, so that no feature takes what others explain as well. Then pairs are ranked
by how much more cuts in both explain of what the features leave than cuts in one, and the best get tables in the same way.

Spark counts features in one scan and joins the labels. The tables are fitted on the driver over at most about ``SAMPLE`` different labelled rows, taken by a
hash of the row, so that partitions don't matter; scores are additions over columns of bins, batch by batch.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import map_batches, settled, staged, table, text_bytes
from tessitura.llm.langid import held_out

FEATURES = (
    "words", "word_length", "longest_word", "short_words", "different_words", "commonest_word", "repeated_words", "line_length", "repeated_lines", "sentence_ends",
    "capitals", "digits", "stops", "marks", "symbols", "beyond_ascii",
)
#: Different labelled rows that the model is fitted on: all if there are fewer, else a share by hash that is expected to have this many.
SAMPLE = 20_000
BINS, PAIRS = 32, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, SHRINK, LEAST = 120, 60, 0.15, 4, 1.0, 2.0
THRESHOLD = 0.7
#: Pairs are cut at this many bins a side.
PAIR_BINS = 16
CAPITALS, DIGITS, STOPS, CONTINUED, BEYOND = bytes(range(65, 91)), b"0123456789", b".,;:?", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))
MARKS, SYMBOLS = b"!\"'()-/[]", b"#$%&*+<=>@\\^_`{|}~"


def text_features(text: bytes | None) -> list[float]:
    """The numbers that ``FEATURES`` names. A text without words has zeros but for shares of characters."""
    text = text or b""
    points = len(text.translate(None, CONTINUED)) or 1
    share = lambda these: (len(text) - len(text.translate(None, these))) / points
    of_characters = [share(CAPITALS), share(DIGITS), share(STOPS), share(MARKS), share(SYMBOLS), share(BEYOND)]
    words = text.split()
    if not words:
        return [0.0] * (len(FEATURES) - len(of_characters)) + of_characters
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = text.split(b"\n")
    return [
        float(np.log1p(n)), float(lengths.mean()), float(np.log1p(lengths.max())), float(np.count_nonzero(lengths <= 3) / n), len(counts) / n, max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n, float(np.log1p(len(text) / len(lines))), 1 - len(set(lines)) / len(lines), (text.count(b". ") + text.count(b".\n")) / n,
        *of_characters,
    ]


def with_features(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns of ``df`` and x, the features of each whole text."""
    fields = [df.schema[c] for c in carry]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([text_features(t) for t in text_bytes(batch.column(0))], np.float32).reshape(-1)
        ends = pa.array(np.arange(0, len(x) + 1, len(FEATURES), dtype=np.int32))
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(ends, pa.array(x))], [*carry, "x"])

    return map_batches(df.select(F.col(text_col).alias("__text"), *carry), run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "x array<float>"]))


@dataclass
class Gam:
    """Bin edges and tables of all features, and tables of pairs (first, second)."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]

    def coarse(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries by bins."""
        out = np.full(len(x), self.base)
        for own, values in zip(self.bins(x), self.tables):
            out += values[own]
        if self.pairs:
            coarse = self.coarse(x)
            for (f, g), values in zip(self.pairs, self.pair_tables):
                out += values[coarse[f], coarse[g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def cut_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges between at most ``bins`` bins of as many different values each, so that a value which most texts have takes no room from the others."""
    values = np.unique(x).astype(np.float64)
    last = np.unique(np.arange(1, bins) * len(values) // bins)
    last = last[(last > 0) & (last < len(values))]
    return (values[last - 1] + values[last]) / 2


def gains(g: np.ndarray, h: np.ndarray, axis: int = 0) -> np.ndarray:
    """What a cut after each place along ``axis`` gains, all else summed up; minus infinity where a side is too light."""
    other = tuple(i for i in range(g.ndim) if i != axis)
    left_g, left_h = np.cumsum(g.sum(axis=other)), np.cumsum(h.sum(axis=other))
    right_g, right_h = left_g[-1] - left_g, left_h[-1] - left_h
    out = left_g**2 / (left_h + SHRINK) + right_g**2 / (right_h + SHRINK) - left_g[-1] ** 2 / (left_h[-1] + SHRINK)
    return np.where((left_h >= LEAST) & (right_h >= LEAST), out, -np.inf)[:-1]


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf values of a tree over a table of gradients and weights: at most ``leaves`` boxes, cut where it gains most."""
    boxes = [tuple(slice(0, n) for n in g.shape)]
    while len(boxes) < leaves:
        best = (1e-9, None)
        for b, box in enumerate(boxes):
            for axis in range(g.ndim):
                found = gains(g[box], h[box], axis)
                if len(found) and found.max() > best[0]:
                    best = (float(found.max()), (b, axis, int(found.argmax()) + 1))
        if best[1] is None:
            break
        b, axis, at = best[1]
        box = boxes.pop(b)
        middle = box[axis].start + at
        boxes += [tuple(slice(*ends) if i == axis else s for i, s in enumerate(box)) for ends in ((box[axis].start, middle), (middle, box[axis].stop))]
    out = np.zeros(g.shape)
    for box in boxes:
        out[box] = g[box].sum() / (h[box].sum() + SHRINK)
    return out


def fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Gam:
    """The model of examples (rows of features, 0 or 1, how often). Without examples of both kinds all scores are alike."""
    good, bad = float(weights[y == 1].sum()), float(weights[y == 0].sum())
    edges = [cut_edges(x[:, f], BINS) for f in range(len(FEATURES))]
    model = Gam(edges, float(np.log((good + 0.5) / (bad + 0.5))), [np.zeros(len(e) + 1) for e in edges])
    if not good or not bad:
        return model
    margin = np.full(len(y), model.base)

    def boosted(own: np.ndarray, values: np.ndarray) -> None:
        """One tree over the bins ``own``, added to ``values`` and to the margins."""
        p = 1 / (1 + np.exp(-margin))
        g = np.bincount(own, weights * (y - p), values.size).reshape(values.shape)
        h = np.bincount(own, weights * p * (1 - p), values.size).reshape(values.shape)
        step = RATE * shallow_tree(g, h)
        values += step
        margin[:] += step.reshape(-1)[own]

    bins = model.bins(x)
    for _ in range(ROUNDS):
        for own, values in zip(bins, model.tables):
            if values.size > 1:
                boosted(own, values)
    model.pair_edges = [cut_edges(x[:, f], PAIR_BINS) for f in range(len(FEATURES))]
    coarse = model.coarse(x)
    p = 1 / (1 + np.exp(-margin))
    left, weight = weights * (y - p), weights * p * (1 - p)

    def joint(f: int, k: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model.pair_edges[f]) + 1, len(model.pair_edges[k]) + 1)
        return coarse[f] * shape[1] + coarse[k], shape

    def promise(pair: tuple[int, int]) -> float:
        own, shape = joint(*pair)
        g, h = (np.bincount(own, v, shape[0] * shape[1]).reshape(shape) for v in (left, weight))
        alone = max((shallow_tree(g.sum(axis=i), h.sum(axis=i)) * g.sum(axis=i)).sum() for i in (0, 1))
        return float((shallow_tree(g, h) * g).sum() - alone)

    usable = [f for f in range(len(FEATURES)) if len(model.pair_edges[f])]
    model.pairs = sorted(combinations(usable, 2), key=lambda pair: (-promise(pair), pair))[:PAIRS]
    grids = [joint(*pair) for pair in model.pairs]
    model.pair_tables = [np.zeros(shape) for _, shape in grids]
    for _ in range(PAIR_ROUNDS):
        for (own, _), values in zip(grids, model.pair_tables):
            boosted(own, values)
    return model


def fit_quality(featured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """The model of rows (doc_id, x) outside the held-out fold with labels (doc_id, quality); of several labels of one id any 1 counts."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("y"))
    examples = staged(featured.where(~held_out()).join(known, "doc_id").groupBy("x", "y").agg(F.count("*").alias("n")), "examples")
    many = examples.count()
    share = F.pmod(F.xxhash64("x", "y"), F.lit(1 << 32)) < F.lit(int(min(1.0, sample / max(many, 1)) * (1 << 32)))
    rows = examples.where(share).toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    y, n = rows.column("y").to_numpy(), rows.column("n").to_numpy().astype(np.float64)
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order].astype(np.float64), n[order])


def with_scores(featured: DataFrame, model: Gam, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and score (0 to 1) of rows with features x."""
    fields = [featured.schema[c] for c in carry]
    sent = featured.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sent.value.score(x))], [*carry, "score"])

    return map_batches(featured.select("x", *carry), run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"]), rows=None)


def quality_scores(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of every row; labels of the held-out fold are not learned from.

    A null text is an empty one; it has a score like any other. A null id is in no fold and has no label, repeated rows have equal scores and count as often as they
    occur, labels of unknown ids and null labels teach nothing, and without labels of both kinds all scores are alike.
    """
    featured = staged(with_features(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "features")
    scored = with_scores(featured, fit_quality(featured, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return settled(spark, "quality", lambda: quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
