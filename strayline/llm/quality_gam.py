"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strayline.llm.common import is_held_out, labelled_sample

# Labelled documents of each class that a fit reads at most.
PER_CLASS = 10_000
THRESHOLD = 0.5
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.2

FEATURES = [
    "log_words", "word_chars", "symbols", "exclamations", "bars", "capitals", "digits",
    "sentence_ends", "commas", "log_lines", "line_repeats", "distinct_words", "long_bytes",
]


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all 0 for one without words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(words), sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]

    def of(chars: bytes) -> float:
        return float(count[list(chars)].sum())

    return [
        float(np.log1p(n)),
        size / n,
        of(b"#*$%&<>") / n,
        of(b"!") / n,
        of(b"|") / n,
        _ratio(count[65:91].sum(), count[65:91].sum() + count[97:123].sum()),
        count[48:58].sum() / size,
        of(b".?!") / n,
        of(b",") / n,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
        len(set(words)) / n,
        count[192:].sum() / size,
    ]


@dataclass
class Gam:
    """Lookup tables: one per feature and one per pair; a score is a sum of table entries."""

    base: float
    edges: list[np.ndarray]
    tables: np.ndarray
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, edges in enumerate(self.edges):
            total += self.tables[j][np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), cells in zip(self.pairs, self.pair_tables):
            total += cells[_bin(self.coarse[i], x[:, i]), _bin(self.coarse[j], x[:, j])]
        return total


def _bin(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, side="right")


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values per bin of a shallow tree that follows the gradient sums ``g`` and Hessians ``h``."""
    flat = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return flat
    left_g, left_h = g.cumsum()[:-1], h.cumsum()[:-1]
    gain = left_g**2 / (left_h + 1.0) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1.0)
    k = int(gain.argmax()) + 1
    return np.concatenate([_leaves(g[:k], h[:k], depth - 1), _leaves(g[k:], h[k:], depth - 1)])


def _cells(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The same for a pair: one cut of the first feature, then one of the second on either side."""
    best, values = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(a)):
            rows = [_leaves(a[s].sum(0), b[s].sum(0), 1) for s in (slice(0, k), slice(k, None))]
            cells = np.concatenate([np.tile(rows[0], (k, 1)), np.tile(rows[1], (len(a) - k, 1))])
            gain = float((2 * cells * a - cells**2 * (b + 0.0)).sum())
            if gain > best:
                best, values = gain, cells.T if flip else cells
    return values, best


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Gam:
    """Cyclic boosting: in every round each feature in turn gets a small tree on its own bins; then
    the pairs whose cells explain most of the rest get theirs. No rows: a score of one half."""
    width = x.shape[1]
    if not len(x):
        none = [np.zeros(0)] * width
        return Gam(0.0, none, np.zeros((width, 1)), none, [], np.zeros((0, 1, 1)))
    share = (weight @ y + 1) / (weight.sum() + 2)
    base = float(np.log(share / (1 - share)))
    edges = [_cuts(x[:, j], BINS) for j in range(width)]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(width)]
    bins = [_bin(e, x[:, j]) for j, e in enumerate(edges)]
    tables = np.zeros((width, BINS + 1))
    z = np.full(len(x), base)
    for _ in range(ROUNDS):
        for j in range(width):
            p = _sigmoid(z)
            g = np.bincount(bins[j], weight * (y - p), len(edges[j]) + 1)
            h = np.bincount(bins[j], weight * p * (1 - p), len(edges[j]) + 1)
            step = RATE * _leaves(g, h, 2)
            tables[j, : len(step)] += step
            z += step[bins[j]]
    side = PAIR_BINS + 1
    at = {(i, j): _bin(coarse[i], x[:, i]) * side + _bin(coarse[j], x[:, j]) for i, j in combinations(range(width), 2)}

    def tree(pair: tuple[int, int]) -> tuple[np.ndarray, float]:
        p = _sigmoid(z)
        g = np.bincount(at[pair], weight * (y - p), side * side).reshape(side, side)
        h = np.bincount(at[pair], weight * p * (1 - p), side * side).reshape(side, side)
        return _cells(g, h)

    pairs = sorted(at, key=lambda pair: -tree(pair)[1])[:PAIRS]
    cells = np.zeros((len(pairs), side, side))
    for _ in range(PAIR_ROUNDS):
        for k, pair in enumerate(pairs):
            step = RATE * tree(pair)[0]
            cells[k] += step
            z += step.ravel()[at[pair]]
    return Gam(base, edges, tables, coarse, pairs, cells)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Gam:
    """Fit on the labelled documents that are not held out: ``per_class`` of each class at most, a
    fixed choice by hash. The classes keep the weights they have among all such labels. Only the
    features of the chosen documents reach the driver."""
    kinds = labels.where(~is_held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    totals = {r["quality"]: r["n"] for r in kinds.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = F.broadcast(labelled_sample(labels, "quality", per_class))
    described = F.pandas_udf(
        lambda texts: pd.Series([features(t) for t in texts]), "array<double>"
    )
    rows = (
        docs.select("doc_id", "text")
        .join(chosen, F.col("doc_id") == F.col("_id"))
        .select("doc_id", "label", described("text").alias("x"))
        .toPandas()
        .drop_duplicates("doc_id")
        .sort_values("doc_id")
    )
    y = rows["label"].to_numpy(dtype=float)
    weight = np.ones(len(y))
    for c in (0, 1):
        weight[y == c] = totals.get(c, 0) / max(1, (y == c).sum())
    weight /= weight.mean() if len(y) else 1
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(y), len(FEATURES))
    return fit(x, y, weight)


def quality(model: Gam) -> Column:
    """Score of the column ``text``: the probability of label 1, for a null or empty text too."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        return pd.Series(_sigmoid(model.logits(x)))

    return score("text")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its score: ``(doc_id, held_out, score, predicted)``.

    One row for each row of ``docs``, repeated rows included; ``predicted`` is 1 from THRESHOLD on.
    A null text counts as empty, a null ``doc_id`` as not held out. Without a usable label every
    score is one half. Other columns are not read, and only ``doc_id`` and ``quality`` of labels.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), quality(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score at least THRESHOLD, with all columns."""
    return docs.where(quality(train(docs, labels)) >= THRESHOLD)
