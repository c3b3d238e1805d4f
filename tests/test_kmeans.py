import math
import random
import tracemalloc
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa

import pytest
from conftest import points_frame

from strayline.operators.clusters import assign_nearest, cluster_distance, cluster_entropy
from strayline.operators import lloyd, moments
from strayline.operators.vectors import feature_stats, zscore
from strayline.plans import kmeans
from strayline.plans.detect import detect_outliers
from strayline.plans.kmeans import (
    assign_by_model, detect_kmeans, find_kmeans_outliers, fit_kmeans, model_centers, prepare,
    score_models, sweep_k,
)


@pytest.fixture(scope="module")
def blobs(spark):
    """Three labeled groups, and one point far out in each."""
    rng = random.Random(11)
    rows = []
    for g, (x, y) in enumerate([(0, 0), (50, 0), (0, 50)]):
        rows += [(len(rows) + i, "abc"[g], [rng.gauss(x, 1), rng.gauss(y, 1)]) for i in range(40)]
    rows += [(900, "a", [8.0, 8.0]), (901, "b", [58.0, -8.0]), (902, "c", [-8.0, 58.0])]
    return points_frame(spark, rows)


def test_detect_finds_the_far_points(blobs):
    got = detect_kmeans(zscore(blobs), 3, 20, 1).collect()
    assert sorted(r["id"] for r in got) == [900, 901, 902]
    assert sorted(r["cluster"] for r in got) == [0, 1, 2]
    assert got[0].asDict().keys() == {"cluster", "distance", "id", "label", "features"}


def test_invariants_of_a_fit(blobs):
    normalized = zscore(blobs)
    model = fit_kmeans(normalized, 6, 10)
    assigned = assign_by_model(normalized, model).collect()
    centers = model.tolist()
    assert len(assigned) == 123
    for r in assigned:
        distances = [math.dist(r["features"], c) for c in centers]
        assert math.isclose(r["distance"], distances[r["cluster"]], abs_tol=1e-9)
        assert r["distance"] <= min(distances) + 1e-9
    kept = detect_kmeans(normalized, 6, 10, 4).collect()
    by_cluster = defaultdict(list)
    for r in assigned:
        by_cluster[r["cluster"]].append(r)
    for c, rows in by_cluster.items():
        expected = sorted(rows, key=lambda r: (-r["distance"], r["id"]))[:4]
        assert {r["id"] for r in kept if r["cluster"] == c} == {r["id"] for r in expected}


def test_same_seed_same_result(blobs):
    a = detect_kmeans(zscore(blobs), 5, 10, 2).collect()
    b = detect_kmeans(zscore(blobs), 5, 10, 2).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_scores_of_many_models_equal_those_of_each(spark, blobs):
    normalized = zscore(blobs)
    models = {k: fit_kmeans(normalized, k, 5) for k in (2, 4)}
    for strategy, alone in (("entropy", cluster_entropy), ("distance", cluster_distance)):
        scores = {r["k"]: r["score"] for r in score_models(normalized, models, strategy).collect()}
        for k, model in models.items():
            one = alone(assign_nearest(normalized, model_centers(model, normalized))).first()["score"]
            assert math.isclose(scores[k], one, rel_tol=1e-9, abs_tol=1e-12)


def test_sweep_and_find_agree(blobs):
    normalized = zscore(blobs)
    scores = {r["k"]: r["score"] for r in sweep_k(normalized, "entropy", 10, ks=(2, 3, 4)).collect()}
    k, again = prepare(blobs, "entropy", 10, ks=(2, 3, 4))
    assert scores.keys() == {2, 3, 4} and k == min(scores, key=lambda x: (scores[x], x))
    assert sorted(map(str, again.collect())) == sorted(map(str, normalized.collect()))
    found = find_kmeans_outliers(blobs, "entropy", iterations=10, top=1, ks=(2, 3, 4))
    assert found.select("cluster").distinct().count() == k


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def repeated(spark):
    """Points of which many share an id or are equal, with values of very different size."""
    rng = random.Random(12)
    rows = [(i % 90, "ab"[i % 2], [rng.gauss(0, 1) * 10 ** (i % 5), float(rng.randint(0, 3)), 1e9 + rng.random()]) for i in range(400)]
    return rows + rows[:40]


def test_layout_changes_no_bit(spark, repeated):
    """Order, files and partitions of the points: the same statistics, z-scores, scores and outliers."""
    def results(rows, partitions):
        points = points_frame(spark, rows).repartition(partitions)
        found = find_kmeans_outliers(points, "distance", iterations=6, top=3, ks=(3, 7))
        return [rows_of(x) for x in (feature_stats(points), zscore(points), sweep_k(points, "entropy", 4, ks=(2, 5)), found)]

    first = results(repeated, 1)
    random.Random(13).shuffle(repeated)
    assert results(repeated, 3) == first
    assert results(repeated[::-1], 7) == first


def test_statistics_are_exact(spark):
    rng = random.Random(14)
    column = [rng.choice([1e16, -1e16, 1.0, 0.1, 3e-9]) * rng.random() for _ in range(500)]
    points = points_frame(spark, [(i, "a", [x, 5.0]) for i, x in enumerate(column)])
    got = {r["pos"]: r for r in feature_stats(points.repartition(4)).collect()}
    exact = [Fraction(x) for x in column]
    mean = sum(exact) / 500
    assert (got[0]["total"], got[0]["mean"]) == (math.fsum(column), float(mean))
    assert got[0]["stdev"] == math.sqrt(sum((x - mean) ** 2 for x in exact) / 500)
    assert (got[1]["n"], got[1]["mean"], got[1]["stdev"]) == (500, 5.0, 0.0)
    odd = feature_stats(points_frame(spark, [(1, "a", [math.inf, 1.0]), (2, "a", [0.0, 2.0])])).collect()
    assert math.isnan(odd[0]["mean"]) != math.isnan(odd[1]["mean"])


def test_a_round_moves_centers_to_the_means(spark, repeated):
    points = points_frame(spark, repeated)
    packed = lloyd.measure(lloyd.pack(points, 42))
    assert (packed.n, packed.dim) == (440, 3)
    candidates, weights = lloyd._candidates(packed, 6)
    assert weights.sum() == 440 and len(np.unique(candidates, axis=0)) == len(candidates)
    models = {k: lloyd._seeds(candidates, weights, k, 42) for k in (2, 6)}
    x = np.array([r[2] for r in repeated])
    for k, after in lloyd._moved(packed, models).items():
        own = np.argmin(((x[:, None] - models[k]) ** 2).sum(axis=2), axis=1)
        for c in range(len(after)):
            expected = x[own == c].mean(axis=0) if (own == c).any() else models[k][c]
            assert after[c] == pytest.approx(expected, rel=1e-12, abs=1e-6)  # the grid is that of 1e9


def test_close_centers_are_told_apart():
    x = np.array([[1e8, 0.0], [1e8 + 1, 0.0], [0.5, 1e8]])
    centers = np.array([[1e8 + 0.4, 0.0], [1e8 + 0.6, 0.0], [0.0, 1e8], [1.0, 1e8]])
    assert lloyd.nearest(x, centers).tolist() == [0, 1, 2]  # the last is a tie


def test_nothing_stays_cached(spark, blobs):
    find_kmeans_outliers(blobs, "distance", iterations=2, top=1, ks=(2, 3)).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_fewer_points_than_k(spark):
    points = points_frame(spark, [(i, "a", [float(i), 0.0]) for i in range(4)])
    got = find_kmeans_outliers(points, "distance", iterations=5, top=2).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3]


def test_no_points(spark):
    assert detect_outliers(points_frame(spark, []), "KMEANS", top=1, iterations=1, strategy="entropy").collect() == []
    assert detect_kmeans(points_frame(spark, []), 3, 1, 1).collect() == []


def test_sweep_range():
    assert list(kmeans.SWEEP_KS) == list(range(5, 41, 5))


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="strategy"):
        find_kmeans_outliers(points_frame(spark, []), "best", iterations=1, top=1)


def _peak_mb(run, batch):
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_statistics_of_a_batch_take_little_memory_beside_it():
    x = np.random.default_rng(3).normal(size=(10_000, 64))
    batch = pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], ["features"])
    assert _peak_mb(moments._partial, batch) < 30


def test_points_are_assigned_by_one_python_step(spark):
    rows = [(i, "a", [float(i % 7), None if i == 3 else float(i % 5)]) for i in range(100)] + [(100, "b", None)]
    points = spark.createDataFrame(rows, "id long, label string, features array<double>")
    model = np.array([[0.0, 0.0], [6.0, 4.0]])
    found = assign_by_model(points, model)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["id"]: r for r in found.collect()}
    assert sorted(got) == list(range(100))
    assert got[41]["cluster"] == 1 and got[41]["distance"] == 3.0 and got[41]["features"] == [6.0, 1.0]
    whole = lloyd.assign(lloyd.pack(points, 42), [model]).select("id", "clusters", "distances").where("id <> 3").collect()
    assert {r["id"]: (r["clusters"][0], r["distances"][0]) for r in whole} == {
        i: (r["cluster"], r["distance"]) for i, r in got.items() if i != 3
    }
