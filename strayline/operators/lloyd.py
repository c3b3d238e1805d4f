"""K-means of many models at a time, free of the order and the partitions of the points.

Whatever is drawn is a hash of the point's content, and whatever is added is whole numbers: features
and squared distances on a fixed grid. So a fit depends on the set of points alone. A pass over the
points serves all models: a task sums up per (model, cluster), and one row of each leaves it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

# Points that a task holds as a matrix at a time: what it makes of them stays small beside the batch
# Spark sends, since its worker keeps the most it ever held.
_ROWS = 2_048
# Bits of a feature on its grid, in two halves whose sums are exact in doubles; those of a cost.
_GRID_BITS, _HALF = 52, 26
_COST_BITS = 40
# Distances from matrix products are trusted up to this part of the squared lengths.
_TOLERANCE = 1e-9

# Rounds of seeding, candidates that a round draws per center, rounds on the candidates alone.
SEED_ROUNDS, OVERSAMPLE, CANDIDATE_ROUNDS = 2, 2, 10
# A model is done when no center moved farther than this.
MOVED = 1e-4

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Packed(NamedTuple):
    """Points ``(id, label, packed, hash)``, their number, dimension, largest absolute value, and the
    point of the least hash."""

    points: DataFrame
    n: int
    dim: int
    largest: float
    first: bytes


Model = np.ndarray  # centers, a row each


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(x: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(x), seed, dtype=np.uint64)
    for column in x.T:
        h = _mixed((h + _MIX) ^ np.ascontiguousarray(column).view(np.uint64))
    return h


def _vectors(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, a row each; a missing value is NaN."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    dim = int(sizes[0]) if len(sizes) else 0
    if (sizes != dim).any():
        raise ValueError("points have vectors of unequal length")
    return (column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0).reshape(len(sizes), dim)


def _lists(rows: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def pack(points: DataFrame, seed: int) -> DataFrame:
    """Points with their features as bytes, in which a pass reads them without a copy, and a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            x = _vectors(part.column(2))
            hashed = _hashes(x, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(hashed)],
                ["id", "label", "packed", "hash"],
            )

    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    wanted = points.select("id", "label", "features").where("features is not null")
    return wanted.mapInArrow(run, f"{kinds}, packed binary, hash long")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), np.float64).reshape(len(column), dim)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            yield batch.slice(low, _ROWS)


def measure(points: DataFrame) -> Packed | None:
    """What a fit has to know of packed points; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sizes = np.diff(np.frombuffer(part.column(0).buffers()[1], np.int32)[part.column(0).offset :][: part.num_rows + 1])
            dim = int(sizes[0]) // 8
            if (sizes != 8 * dim).any():
                raise ValueError("points have vectors of unequal length")
            x, h = _matrix(part.column(0), dim), part.column(1).to_numpy().view(np.uint64)
            at = min(np.flatnonzero(h == h.min()).tolist(), key=lambda i: x[i].tobytes())
            row = [part.num_rows, dim, float(np.abs(x).max(initial=0)), int(h[at].view(np.int64)), x[at].tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["n", "dim", "largest", "hash", "first"])

    parts = points.select("packed", "hash").mapInArrow(run, "n long, dim int, largest double, hash long, first binary")
    # hashes are compared as unsigned numbers
    order = F.struct(F.col("hash").bitwiseXOR(F.lit(-(2**63))).alias("h"), "first")
    found = parts.agg(
        F.sum("n").alias("n"), F.min("dim").alias("low"), F.max("dim").alias("high"),
        F.max("largest").alias("largest"), F.min(order)["first"].alias("first"),
    ).first()
    if not found["n"]:
        return None
    if found["low"] != found["high"]:
        raise ValueError("points have vectors of unequal length")
    return Packed(points, found["n"], found["low"], found["largest"], bytes(found["first"]))


def _squared(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Squared distances, added in the order of the features whatever the number of points is."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += (x[:, j] - center[j]) ** 2
    return out


def nearest(x: np.ndarray, centers: Model) -> np.ndarray:
    """The nearest center of every point; equal distances: the first.

    Matrix products tell it for nearly all points; where two centers are too close for them, the
    distances are added feature by feature.
    """
    own = np.einsum("ij,ij->i", x, x)
    length = np.einsum("ij,ij->i", centers, centers)
    squares = x @ (-2 * centers.T)  # but for the length of the point, which is the same for all centers
    squares += length
    found = squares.argmin(axis=1)
    every = np.arange(len(x))
    least = squares[every, found]
    squares[every, found] = np.inf
    limit = least + _TOLERANCE * (own + length.max())
    unsure = np.flatnonzero(squares.min(axis=1) <= limit)
    if len(unsure):
        close = squares[unsure] <= limit[unsure, None]
        close[np.arange(len(unsure)), found[unsure]] = True
        exact = np.full((len(unsure), len(centers)), np.inf)
        for k in range(len(centers)):
            of_k = close[:, k]
            exact[of_k, k] = _squared(x[unsure[of_k]], centers[k])
        found[unsure] = exact.argmin(axis=1)
    return found


def _nearest_squares(x: np.ndarray, centers: Model) -> np.ndarray:
    found = nearest(x, centers)
    out = np.zeros(len(x))
    for k in np.unique(found):
        of_k = found == k
        out[of_k] = _squared(x[of_k], centers[k])
    return out


def _costs(x: np.ndarray, centers: Model, packed: Packed) -> np.ndarray:
    """Squared distances to the nearest center on a grid of 2**_COST_BITS steps, as whole numbers."""
    most = 4 * packed.dim * packed.largest**2 or 1.0
    return np.rint(_nearest_squares(x, centers) / most * 2**_COST_BITS).astype(np.int64)


def _drawn(packed: Packed, centers: Model, per_round: int, turn: int) -> list[bytes]:
    """Points drawn by their share of the cost times ``per_round``; a point's draw is its hash."""
    told = packed._replace(points=None)

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(int(_costs(_matrix(b.column(0), told.dim), centers, told).sum()) for b in _slices(batches))
        halves = [pa.array([v], pa.int64()) for v in (total >> 32, total & (1 << 32) - 1)]
        yield pa.RecordBatch.from_arrays(halves, ["high", "low"])

    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    whole = packed.points.select("packed").mapInArrow(cost, "high long, low long").agg(*sums).first()
    total = (int(whole["high"]) << 32) + int(whole["low"])
    if not total:
        return []

    salt = np.uint64(turn * int(_MIX) % 2**64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            x = _matrix(part.column(0), told.dim)
            h = _mixed(part.column(1).to_numpy().view(np.uint64) + salt)
            draws = (h >> np.uint64(11)).astype(float) / 2**53
            chosen = np.flatnonzero(draws * (total / per_round) < _costs(x, centers, told))
            yield pa.RecordBatch.from_arrays([pa.array([x[i].tobytes() for i in chosen], pa.binary())], ["packed"])

    rows = packed.points.select("packed", "hash").mapInArrow(draw, "packed binary").distinct()
    return [bytes(r["packed"]) for r in rows.collect()]


def _candidates(packed: Packed, most: int) -> tuple[Model, np.ndarray]:
    """Candidate centers in the order of their content, and how many points each one is nearest to."""
    found = {packed.first}
    unpacked = lambda: np.array([np.frombuffer(c) for c in sorted(found)]).reshape(len(found), packed.dim)
    for turn in range(1, SEED_ROUNDS + 1):
        found.update(_drawn(packed, unpacked(), OVERSAMPLE * most, turn))
    centers = unpacked()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centers), dtype=np.int64)
        for part in _slices(batches):
            n += np.bincount(nearest(_matrix(part.column(0), centers.shape[1]), centers), minlength=len(n))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n[own])], ["nr", "n"])

    weights = np.zeros(len(centers))
    counted = packed.points.select("packed").mapInArrow(weigh, "nr long, n long").groupBy("nr").agg(F.sum("n").alias("n"))
    for row in counted.collect():
        weights[row["nr"]] = row["n"]
    return centers, weights


def _seeds(candidates: Model, weights: np.ndarray, k: int, seed: int) -> Model:
    """``k`` of the candidates, or all if there are no more, drawn by weight and distance, then moved
    by rounds on the candidates alone."""
    if len(candidates) <= k:
        return candidates
    draw = np.random.default_rng([seed, k])
    chosen = [int(draw.choice(len(candidates), p=weights / weights.sum()))]
    cost = _squared(candidates, candidates[chosen[0]])
    while len(chosen) < k and (cost * weights).any():
        chosen.append(int(draw.choice(len(candidates), p=cost * weights / (cost * weights).sum())))
        cost = np.minimum(cost, _squared(candidates, candidates[chosen[-1]]))
    centers = candidates[chosen]
    for _ in range(CANDIDATE_ROUNDS):
        squares = np.stack([_squared(candidates, c) for c in centers], axis=1)
        own = squares.argmin(axis=1)
        moved = centers.copy()
        for c in range(len(centers)):
            w = weights * (own == c)
            if w.any():
                moved[c] = (candidates * w[:, None]).sum(axis=0) / w.sum()
        if (moved == centers).all():
            break
        centers = moved
    return centers


def _grid(packed: Packed) -> int:
    """The power of two that makes whole numbers of up to _GRID_BITS bits of the features, by the
    largest of them all: what is lost of a small feature is nothing beside the distances."""
    return _GRID_BITS - math.frexp(packed.largest)[1] if packed.largest else 0


def _moved(packed: Packed, models: dict[int, Model]) -> dict[int, Model]:
    """All models after one round: every center is the mean of its points, one without points stays."""
    dim, grid = packed.dim, _grid(packed)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = {m: np.zeros((3, len(c), dim), dtype=np.int64) for m, c in models.items()}
        for part in _slices(batches):
            x = _matrix(part.column(0), dim)
            whole = np.rint(np.ldexp(x.T, grid, order="C")).astype(np.int64)  # a row per feature
            high, low = (whole >> _HALF).astype(float), (whole & ((1 << _HALF) - 1)).astype(float)
            for m, centers in models.items():
                own = nearest(x, centers)
                # whole numbers below 2**26, few thousand of them: their sums in doubles are exact
                for j in range(dim):
                    added[m][0, :, j] += np.bincount(own, high[j], len(centers)).astype(np.int64)
                    added[m][1, :, j] += np.bincount(own, low[j], len(centers)).astype(np.int64)
                added[m][2] += np.bincount(own, minlength=len(centers))[:, None]
        yield _as_rows({(m, c): a[:, c] for m, a in added.items() for c in range(a.shape[1]) if a[2, c, 0]})

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = defaultdict(lambda: np.zeros((3, dim), dtype=object))
        for batch in batches:
            for row in batch.to_pylist():
                total[row["model"], row["cluster"]] += np.array([row["high"], row["low"], [row["n"]] * dim], dtype=object)
        rows = [(*key, [((int(h) << _HALF) + int(l)) / (int(n) << max(grid, 0)) * 2.0 ** max(-grid, 0) for h, l, n in zip(*s)]) for key, s in total.items()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64())))]
        yield pa.RecordBatch.from_arrays(columns, ["model", "cluster", "center"])

    partial = packed.points.select("packed").mapInArrow(sums, "model int, cluster int, n long, high array<long>, low array<long>")
    rows = partial.repartition("model", "cluster").mapInArrow(combined, "model int, cluster int, center array<double>")
    after = {m: c.copy() for m, c in models.items()}
    for row in rows.collect():
        after[row["model"]][row["cluster"]] = row["center"]
    return after


def _as_rows(sums: dict) -> pa.RecordBatch:
    columns = [
        pa.array([m for m, _ in sums], pa.int32()), pa.array([c for _, c in sums], pa.int32()),
        pa.array([int(s[2, 0]) for s in sums.values()], pa.int64()),
        *[pa.array([s[i].tolist() for s in sums.values()], pa.list_(pa.int64())) for i in range(2)],
    ]
    return pa.RecordBatch.from_arrays(columns, ["model", "cluster", "n", "high", "low"])


def fit(packed: Packed, ks: Sequence[int], iterations: int, seed: int) -> dict[int, Model]:
    """A model of ``k`` centers, or as many as there are different points, for each k.

    All models share the candidates they are seeded from and every pass over the points; a model
    whose centers stand still takes no part in further passes. At most ``iterations`` rounds.
    """
    candidates, weights = _candidates(packed, max(ks))
    models = {k: _seeds(candidates, weights, k, seed) for k in ks}
    moving = dict(models)
    for _ in range(iterations):
        after = _moved(packed, moving)
        models |= after
        moving = {k: c for k, c in after.items() if (((c - moving[k]) ** 2).sum(axis=1) > MOVED**2).any()}
        if not moving:
            break
    return models


def assign(points: DataFrame, models: Sequence[Model], with_features: bool = True) -> DataFrame:
    """Points with the cluster in each of the models and the distance to its center:
    ``(id, label[, features], clusters, distances)``. Points are packed or have ``features``; those are
    read as they are, so that a task needs one Python worker and not a second one that packs."""
    is_packed = "packed" in points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            dim = models[0].shape[1]
            x = _matrix(part.column(2), dim) if is_packed else _vectors(part.column(2))
            if x.shape[1] != dim:
                raise ValueError("points and centers have vectors of unequal length")
            found = np.stack([nearest(x, c) for c in models], axis=1)
            far = np.zeros(found.shape)
            for m, centers in enumerate(models):
                gap = np.zeros(len(x))
                for j in range(x.shape[1]):
                    gap += (x[:, j] - centers[found[:, m], j]) ** 2
                far[:, m] = np.sqrt(gap)
            features = [_lists(x)] if with_features else []
            arrays = [_lists(found.astype(np.int32)), _lists(far)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *features, *arrays], names)

    names = ["id", "label", *(["features"] if with_features else []), "clusters", "distances"]
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    middle = "features array<double>, " if with_features else ""
    read = points.select("id", "label", "packed") if is_packed else points.select("id", "label", "features").where("features is not null")
    return read.mapInArrow(run, f"{kinds}, {middle}clusters array<int>, distances array<double>")
