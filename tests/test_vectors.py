import math
import random
import statistics

import pytest
from conftest import points_frame
from pyspark.sql import functions as F

from strayline.functions import euclidean
from strayline.operators.vectors import assemble_points, feature_stats, zscore

GOLDEN = [
    (1, "a", [1.0, 10.0, 5.0]), (2, "b", [2.0, 10.0, 7.0]),
    (3, "a", [3.0, 10.0, 9.0]), (4, "b", [6.0, 10.0, 3.0]),
]


def cells_frame(spark, rows):
    return spark.createDataFrame(rows, "row long, col long, lbl string, val double")


def test_feature_stats_golden(spark):
    rows = feature_stats(points_frame(spark, GOLDEN)).orderBy("pos").collect()
    assert [(r["pos"], r["n"], r["total"]) for r in rows] == [(0, 4, 12.0), (1, 4, 40.0), (2, 4, 24.0)]
    assert [round(r["mean"], 6) for r in rows] == [3.0, 10.0, 6.0]
    assert [round(r["stdev"], 6) for r in rows] == [1.870829, 0.0, 2.236068]


def test_zscore_golden(spark):
    got = {r["id"]: [round(z, 6) for z in r["features"]] for r in zscore(points_frame(spark, GOLDEN)).collect()}
    assert got == {
        1: [-1.069045, 0.0, -0.447214], 2: [-0.534522, 0.0, 0.447214],
        3: [0.0, 0.0, 1.341641], 4: [1.603567, 0.0, -1.341641],
    }


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_zscore_does_not_depend_on_partitions(spark, partitions):
    rng = random.Random(7)
    rows = [(i, "x", [rng.gauss(100, 5), rng.random()]) for i in range(200)]
    z = zscore(points_frame(spark, rows).repartition(partitions)).collect()
    for pos in (0, 1):
        values = [r["features"][pos] for r in z]
        assert math.isclose(statistics.fmean(values), 0, abs_tol=1e-9)
        assert math.isclose(statistics.pstdev(values), 1, rel_tol=1e-9)


def test_zscore_needs_no_join_and_no_shuffle_of_points(spark):
    plan = zscore(points_frame(spark, GOLDEN))._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Join" not in main and "Exchange" not in main


def test_unequal_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="(?i)dimension"):
        zscore(points_frame(spark, [(1, "a", [1.0, 2.0]), (2, "a", [1.0])])).collect()


def test_empty_points(spark):
    assert zscore(points_frame(spark, [])).collect() == []


def test_assemble_points(spark):
    rows = [(r, c, f"l{r}", r * 10.0 + c) for c in (2, 0, 1) for r in (5, 3)]
    got = {r["id"]: (r["label"], r["features"]) for r in assemble_points(cells_frame(spark, rows)).collect()}
    assert got == {3: ("l3", [30.0, 31.0, 32.0]), 5: ("l5", [50.0, 51.0, 52.0])}


@pytest.mark.parametrize(
    "extra, message",
    [
        ([(2, 0, "b", 1.0)], "unequal length"),  # missing cell
        ([(2, 0, "b", 1.0), (2, 1, "b", 1.0), (2, 1, "b", 2.0)], "unequal length"),  # surplus cell
        ([(2, 1, "b", 1.0), (2, 1, "b", 2.0)], "cell given twice"),
        ([(2, 0, "b", 1.0), (2, 1, "b", None)], "without value"),
    ],
)
def test_assemble_points_rejects_bad_rows(spark, extra, message):
    cells = cells_frame(spark, [(1, 0, "a", 1.0), (1, 1, "a", 2.0), *extra])
    with pytest.raises(Exception, match=message):
        assemble_points(cells).collect()


def test_euclidean(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(euclidean("a", "b")).first()[0] == 5.0
    assert df.select(euclidean(F.col("a"), F.col("a"))).first()[0] == 0.0
