"""Clustering detector: z-scores, choice of k, farthest points of each cluster."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from strayline.operators.clusters import best_k, centers_frame, top_per_cluster
from strayline.operators.entropy import str_entropy
from strayline.operators.lloyd import Model, Packed, assign, fit, measure, pack
from strayline.operators.moments import exact_moments
from strayline.operators.vectors import zscore
from strayline.sources.store import write_scratch

# Numbers of clusters that are tried.
SWEEP_KS = (5, 10, 15, 20, 25, 30, 35, 40)
STRATEGIES = ("distance", "entropy")
SEED = 42


def check_strategy(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy '{strategy}', expected one of {', '.join(STRATEGIES)}")
    return strategy


@contextmanager
def _kept(points: DataFrame) -> Iterator[Packed | None]:
    """Keep the points, packed, while passes read them; a lost block is computed again.

    They are dealt out evenly, in as many partitions as their size asks for. None: no points.
    """
    kept = pack(points, SEED).hint("rebalance").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield measure(kept)
    finally:
        kept.unpersist()


def fit_kmeans(points: DataFrame, k: int, iterations: int, seed: int = SEED) -> Model:
    """The centers, a row each, of a fit of ``(id, label, features)`` with at most ``iterations``
    rounds. Order, files and partitions of the points do not change it; fewer different points than
    ``k`` are as many centers."""
    with _kept(points) as kept:
        if kept is None:
            raise ValueError("no points to fit")
        return fit(kept, [k], iterations, seed)[k]


def model_centers(model: Model, points: DataFrame) -> DataFrame:
    """The model's centers as ``(cluster, center)``."""
    return centers_frame(points.sparkSession, list(enumerate(model)))


def _scores(points: DataFrame, models: dict[int, Model], strategy: str) -> DataFrame:
    """`score_models` of points, packed or not."""
    ks = F.array(*[F.lit(k) for k in models])
    assigned = assign(points, list(models.values()), with_features=False)
    if strategy == "entropy":
        choices = F.arrays_zip(ks.alias("k"), F.col("clusters").alias("cluster"))
        chosen = assigned.select("label", F.explode(choices).alias("c")).select("c.*", "label")
        per_cluster = str_entropy(chosen, ["k", "cluster"], "label")
        ordered = F.sort_array(F.collect_list(F.struct("cluster", "entropy")))  # one value per cluster
        total = F.aggregate(ordered, F.lit(0.0), lambda acc, c: acc + c["entropy"])
        return per_cluster.groupBy("k").agg((total / F.count(F.lit(1))).alias("score"))
    means = exact_moments(assigned, "distances")
    return means.select(F.get(ks, F.col("pos")).alias("k"), F.col("mean").alias("score"))


def score_models(points: DataFrame, models: dict[int, Model], strategy: str) -> DataFrame:
    """``(k, score)`` of every model, from one pass over the points.

    Each point is put into a cluster of each model; the (k, cluster) rows that come of it are
    combined before they are shuffled, and distances are added exactly.
    """
    return _scores(points, models, check_strategy(strategy))


def sweep_k(points: DataFrame, strategy: str, iterations: int, ks: Sequence[int] = SWEEP_KS) -> DataFrame:
    """Score every k: ``(k, score)``, less is better.

    - ``entropy``: mean label entropy of the clusters; unweighted, and a cluster of one point
      counts as 0, so it favors many small clusters
    - ``distance``: mean distance of the points to their center, which falls as k grows
    """
    check_strategy(strategy)
    rows = []
    with _kept(points) as kept:
        if kept:
            models = fit(kept, ks, iterations, SEED)
            rows = [(r["k"], r["score"]) for r in _scores(kept.points, models, strategy).collect()]
    return points.sparkSession.createDataFrame(rows, "k int, score double")


def _choose(kept: Packed, strategy: str, iterations: int, ks: Sequence[int]) -> tuple[int, Model]:
    """Best k and its model."""
    models = fit(kept, ks, iterations, SEED)
    k = best_k(_scores(kept.points, models, strategy)).first()["k"]
    return k, models[k]


def prepare(
    points: DataFrame, strategy: str = "entropy", iterations: int = 20, ks: Sequence[int] = SWEEP_KS
) -> tuple[int, DataFrame]:
    """Normalize the points and choose k; returns ``(k, normalized points)``."""
    check_strategy(strategy)
    normalized = zscore(points)
    with _kept(normalized) as kept:
        chosen = _choose(kept, strategy, iterations, ks) if kept else None
    return (chosen[0] if chosen else min(ks)), normalized


def assign_by_model(points: DataFrame, model: Model) -> DataFrame:
    """Assigned points of a fitted model, each with the distance to its own center."""
    return _assigned(points, model)


def _assigned(points: DataFrame, model: Model) -> DataFrame:
    return assign(points, [np.asarray(model)]).select(
        F.get("clusters", F.lit(0)).alias("cluster"), F.get("distances", F.lit(0)).alias("distance"),
        "id", "label", "features",
    )


def detect_kmeans(normalized: DataFrame, k: int, iterations: int, top: int) -> DataFrame:
    """Fit ``k`` clusters and return the ``top`` farthest points of each.

    Result: ``(cluster, distance, id, label, features)``, written once to the shared folder while
    the points are kept, so that they are not computed again.
    """
    with _kept(normalized) as kept:
        if not kept:
            return _none_found(normalized)
        model = fit(kept, [k], iterations, SEED)[k]
        return write_scratch(top_per_cluster(_assigned(kept.points, model), top))


def find_kmeans_outliers(
    points: DataFrame, strategy: str = "entropy", *, iterations: int, top: int,
    ks: Sequence[int] = SWEEP_KS,
) -> DataFrame:
    """Normalize, choose k, and return the ``top`` farthest points of each cluster.

    The model of the chosen k is the one fitted while choosing. The points are kept until their
    normalized form is, and that until the result is written: their source is read once.
    """
    check_strategy(strategy)
    own = not points.is_cached
    points = points.persist(StorageLevel.MEMORY_AND_DISK) if own else points
    try:
        with _kept(zscore(points)) as kept:
            if not kept:
                return _none_found(points)
            _, model = _choose(kept, strategy, iterations, ks)
            return write_scratch(top_per_cluster(_assigned(kept.points, model), top))
    finally:
        if own:
            points.unpersist()


def _none_found(points: DataFrame) -> DataFrame:
    return points.select(
        F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"), "id", "label", "features"
    ).limit(0)
