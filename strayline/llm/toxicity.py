"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strayline.llm.common import cut, is_held_out, labelled_sample

# Labelled documents of each class that a fit reads at most.
PER_CLASS = 4_000
THRESHOLD = 0.7
SIZES = (4, 5, 6)
BITS = 20
# N-grams with the largest ratios that get a weight, and the documents that must have one.
WEIGHTS, FEWEST_DOCS = 20_000, 4
SMOOTH, RIDGE, STEPS = 1.0, 1e-3, 300
_CHUNK = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _places(text: str) -> Iterator[np.ndarray]:
    """Hashed places of all n-grams of a lower-cased text, a stretch at a time."""
    units = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    longest = max(SIZES)
    for low in range(0, max(1, len(units) - longest + 1), _CHUNK):
        part = units[low : low + _CHUNK + longest - 1]
        h = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, longest + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            h = (h[:m] ^ part[n - 1 :]) * _MULTIPLIER
            h ^= h >> np.uint64(31)
            if n in SIZES:
                yield ((h + np.uint64(n)) * _MULTIPLIER >> np.uint64(64 - BITS)).astype(np.int64)


def present(text: str | None, weighted: np.ndarray | None = None) -> np.ndarray:
    """Distinct places of a whole text's n-grams, of those with a weight only if a table is given."""
    found = [np.unique(p if weighted is None else p[weighted[p]]) for p in _places(text or "")]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def _places_of(weighted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [present(t.as_py(), weighted) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))],
                ["_id", "label", "places"],
            )

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(lists: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on ``ratio`` of the n-grams present: their weights and the intercept."""
    used, flat = np.unique(np.concatenate([*lists, [0]]), return_inverse=True)
    flat = flat[:-1]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    value = ratio[used][flat]
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(row, value * w[flat], len(lists)) + b
        miss = weight * (_sigmoid(z) - y) / weight.sum()
        g, gb = np.bincount(flat, value * miss[row], len(used)) + RIDGE * w, miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**step) * np.sqrt(1 - 0.999**step)
        w -= rate * m / (np.sqrt(v) + 1e-9)
        b -= rate * mb / (np.sqrt(vb) + 1e-9)
    table = np.zeros(len(ratio))
    table[used] = w * ratio[used]
    return table, b


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Weights per place and the intercept, from the labelled documents that are not held out:
    ``per_class`` of each class at most, a fixed choice by hash, weighted as among all such labels.

    N-grams are counted per class by a Spark aggregate, and the WEIGHTS with the largest ratios are
    kept; only those of each chosen document reach the driver.
    """
    usable = labels.where(~is_held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = F.broadcast(labelled_sample(labels, "toxic", per_class))
    rows = cut(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("_id", "label", "text").dropDuplicates(["_id"]))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, label int, places array<int>"
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return np.zeros(1 << BITS), 0.0
    counts = (
        rows.mapInArrow(_places_of(None), schema)
        .select("label", F.explode("places").alias("place"))
        .groupBy("place")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
        .where(F.col("toxic") + F.col("clean") >= FEWEST_DOCS)
    )
    share = [(F.col(c) + SMOOTH) / (sizes.get(k, 0) + 2 * SMOOTH) for c, k in (("toxic", 1), ("clean", 0))]
    counts = counts.select("place", F.log(share[0] / share[1]).alias("ratio"))
    top = counts.orderBy(F.abs("ratio").desc(), "place").limit(WEIGHTS).toPandas()
    ratio = np.zeros(1 << BITS)
    ratio[top["place"].to_numpy(np.int64)] = top["ratio"]
    found = rows.mapInArrow(_places_of(ratio != 0), schema).toPandas().sort_values("_id")
    y = found["label"].to_numpy(float)
    weight = np.where(y == 1, totals.get(1, 0) / max(1, sizes.get(1, 0)), totals.get(0, 0) / max(1, sizes.get(0, 0)))
    return _descend([np.asarray(x, dtype=np.int64) for x in found["places"]], y, ratio, weight)


def toxicity(table: np.ndarray, intercept: float) -> Column:
    """Probability that the column ``text`` is toxic; a null text counts as empty."""
    weighted, table = table != 0, table.astype(np.float32)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_sigmoid(np.array([table[present(t, weighted)].sum() + intercept for t in texts], dtype=float)))

    return score("text")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its score: ``(doc_id, held_out, score, predicted)``.

    One row for each row of ``docs``, repeated rows included; ``predicted`` is 1 from THRESHOLD on.
    A null text counts as empty, a null ``doc_id`` as not held out; without a usable label every
    score is one half. Other columns are not read, and only ``doc_id`` and ``toxic`` of labels.
    """
    score = toxicity(*train(docs, labels))
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
