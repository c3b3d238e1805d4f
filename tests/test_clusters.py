import math
import random

import numpy as np
import pytest
from conftest import points_frame

from strayline.operators.clusters import (
    assign_nearest, best_k, center_distance, centers_frame, cluster_distance, cluster_entropy,
    top_per_cluster,
)

from strayline.operators.rings import make_rings, with_rings


def random_points(n, dim=3, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice("ab"), [rng.uniform(-5, 5) for _ in range(dim)]) for i in range(n)]


def brute_nearest(features, centers):
    return min((math.dist(features, c), i) for i, c in centers)


@pytest.mark.parametrize("local_values", [1_000_000, 6])
def test_assign_nearest_equals_brute_force(spark, local_values):
    """Both ways: centers as one value, and in rings of two."""
    points, centers = random_points(60), [(i, c) for i, _, c in random_points(9, seed=2)]
    got = assign_nearest(points_frame(spark, points), centers_frame(spark, centers), local_values).collect()
    assert len(got) == 60
    by_id = {p[0]: p for p in points}
    for r in got:
        distance, cluster = brute_nearest(by_id[r["id"]][2], centers)
        assert r["cluster"] == cluster and math.isclose(r["distance"], distance)
        assert (r["label"], r["features"]) == by_id[r["id"]][1:]


def test_rings_keep_points_of_equal_id(spark):
    points = [(1, "a", [0.0]), (1, "a", [9.0]), (1, "a", [0.0])]
    got = assign_nearest(points_frame(spark, points), centers_frame(spark, [(0, [1.0]), (1, [8.0])]), 1)
    assert sorted((r["cluster"], r["distance"]) for r in got.collect()) == [(0, 1.0), (0, 1.0), (1, 1.0)]


def test_twenty_thousand_centers(spark):
    """Equal to brute force, and a point meets few of the rings."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20_000, 4)) + rng.integers(0, 30, size=(20_000, 1)) * 10
    centers[500:540] = centers[499]  # equal centers: the lowest cluster counts
    x = np.concatenate([rng.normal(size=(150, 4)) + rng.integers(0, 30, size=(150, 1)) * 10, centers[480:520], rng.normal(size=(10, 4)) * 1000])
    frame = centers_frame(spark, list(enumerate(centers.tolist()))).repartition(4)
    points = points_frame(spark, [(i, "a", v) for i, v in enumerate(x.tolist())])
    got = {r["id"]: r for r in assign_nearest(points, frame, 2_000).collect()}
    assert len(got) == 200
    for i, v in enumerate(x):
        distances = np.sqrt(((centers - v) ** 2).sum(axis=1))
        assert math.isclose(got[i]["distance"], distances.min(), abs_tol=1e-9)
        assert got[i]["cluster"] == np.flatnonzero(distances <= distances.min() + 1e-12)[0]
    rings = make_rings(frame, 20_000, 4, 2_000, 256)
    met = np.mean([len(r["rings"]) for r in with_rings(points, rings).collect()])
    assert rings.table.count() > 300 and met < 0.1 * rings.table.count()
    assert rings.table.selectExpr("max(size(centers)) as n").first()["n"] < 400


def test_points_far_from_all_centers_meet_few_rings(spark):
    """The rings around them are all about as far as the nearest center; their boxes are not."""
    rng = np.random.default_rng(4)
    centers = np.stack([rng.integers(1, 51, 4_000), 900 + rng.integers(0, 1_000, 4_000) / 10], axis=1).astype(float)
    x = np.stack([rng.integers(1, 51, 300), rng.integers(2_000, 100_000, 300)], axis=1).astype(float)
    x[-20:] = x[:20]  # equal features are looked for once, and every point is in the result
    x[100:150] = centers[:50]
    frame = centers_frame(spark, list(enumerate(centers.tolist())))
    points = points_frame(spark, [(i, "a", v) for i, v in enumerate(x.tolist())])
    got = {r["id"]: r for r in assign_nearest(points, frame, 500).collect()}
    assert len(got) == 300
    for i, v in enumerate(x):
        distances = np.sqrt(((centers - v) ** 2).sum(axis=1))
        assert (got[i]["cluster"], got[i]["distance"]) == (distances.argmin(), pytest.approx(distances.min(), abs=1e-9))
    rings = make_rings(frame, 4_000, 2, 500, 250)
    met = np.mean([len(r["rings"]) for r in with_rings(points, rings).collect()])
    assert met < 8


@pytest.mark.parametrize("local_values", [1_000_000, 1])
def test_equal_distances_take_the_lowest_cluster(spark, local_values):
    got = assign_nearest(
        points_frame(spark, [(1, "a", [0.0])]), centers_frame(spark, [(2, [-1.0]), (1, [1.0])]), local_values
    )
    assert got.first()["cluster"] == 1


def test_scores(spark):
    assigned = assign_nearest(
        points_frame(spark, [(1, "a", [0.0]), (2, "b", [2.0]), (3, "a", [10.0]), (4, "a", [13.0])]),
        centers_frame(spark, [(0, [1.0]), (1, [11.0]), (2, [99.0])]),
    )
    assert cluster_entropy(assigned).first()["score"] == 0.5  # (1 bit + 0 bits) / 2, empty one left out
    assert cluster_distance(assigned).first()["score"] == (1 + 1 + 1 + 2) / 4
    centers = centers_frame(spark, [(0, [1.0]), (1, [11.0])])
    for local_values in (1000, 1):
        again = center_distance(assigned.drop("distance"), centers, local_values)
        assert sorted(map(str, again.collect())) == sorted(map(str, assigned.collect()))


@pytest.mark.parametrize("top", [1, 3, 7, 5000])
def test_top_per_cluster(spark, top):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, 2]), float(rng.randrange(10)), i, "x", [0.0]) for i in range(80)]
    df = spark.createDataFrame(rows, "cluster int, distance double, id long, label string, features array<double>")
    got = sorted((r["cluster"], r["id"]) for r in top_per_cluster(df, top).collect())
    expected = []
    for c in (0, 1, 2):
        ranked = sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], r[2]))
        expected += [(c, r[2]) for r in ranked[:top]]
    assert got == sorted(expected)


def test_top_beyond_the_limit_rule_is_cut_per_salt(spark, monkeypatch):
    """With a rule limit of 2, top 5 goes through the salted round."""
    rows = [(0, float(i % 7), i, "x", [0.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "cluster int, distance double, id long, label string, features array<double>")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    try:
        got = [r["id"] for r in top_per_cluster(df, 5).orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert got == [6, 13, 20, 27, 34]


def test_top_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(0, 1.0, 1, "x", [0.0])], "cluster int, distance double, id long, label string, features array<double>")
    assert "WindowGroupLimit" in top_per_cluster(df, 3)._jdf.queryExecution().executedPlan().toString()


def test_best_k(spark):
    scores = spark.createDataFrame([(20, 0.5), (5, 0.7), (10, 0.5)], "k int, score double")
    assert best_k(scores).first()["k"] == 10
