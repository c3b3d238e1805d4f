"""Assignment of points to centers, cluster scores and the farthest points of each cluster.

An *assigned point* is ``(cluster INT, distance DOUBLE, id LONG, label STRING, features)``; a
*center* is ``(cluster INT, center ARRAY<DOUBLE>)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strayline.functions import euclidean
from strayline.operators.entropy import str_entropy
from strayline.operators.rings import RING_CENTERS, make_rings, with_rings

# Largest center table (in doubles) that is handed whole to every task: 8 MB.
LOCAL_CENTER_VALUES = 1_000_000

# Features up to which a distance is written out term by term.
UNROLLED = 64

_ASSIGNED = ["cluster", "distance", "id", "label", "features"]
_CENTERS = "cluster int, center array<double>"


def _distance(features: str, center: Column, d: int) -> Column:
    """`euclidean` of vectors of ``d`` features, written out where that is short: it is evaluated for
    every center of a point, and nested functions cost much more than the terms."""
    if not 0 < d <= UNROLLED:
        return euclidean(features, center)
    gaps = [F.get(features, F.lit(i)) - F.get(center, F.lit(i)) for i in range(d)]
    return F.sqrt(reduce(lambda total, gap: total + gap * gap, gaps, F.lit(0.0)))


def _nearest(features: str, centers: str, d: int) -> Column:
    """Struct ``(distance, cluster)`` of the nearest center; equal distances: lowest cluster."""
    unequal = F.raise_error(F.lit("vectors of unequal length")).cast("struct<distance:double,cluster:int>")
    odd = (F.size(features) != d) | F.exists(centers, lambda c: F.size(c["center"]) != d)
    best = F.array_min(
        F.transform(
            centers,
            lambda c: F.struct(
                _distance(features, c["center"], d).alias("distance"),
                c["cluster"].alias("cluster"),
            ),
        )
    )
    return F.when(odd, unequal).otherwise(best)


def _typed(centers: DataFrame) -> DataFrame:
    return centers.select(
        F.col("cluster").cast("int"), F.col("center").cast("array<double>").alias("center")
    )


def _measured(centers: DataFrame, local_values: int) -> tuple[DataFrame, int, int]:
    """Centers, their number and their dimension; up to ``local_values`` doubles they are then
    held by the driver. Their source is read once."""
    kept = centers.persist()
    try:
        size = kept.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("center")), F.lit(0)).alias("d")
        ).first()
        if size["n"] * size["d"] <= local_values:
            rows = [(r["cluster"], r["center"]) for r in kept.collect()]
            centers = centers_frame(centers.sparkSession, rows)
        return centers, size["n"], size["d"]
    finally:
        kept.unpersist()


def assign_nearest(
    points: DataFrame, centers: DataFrame, local_values: int = LOCAL_CENTER_VALUES
) -> DataFrame:
    """Give each point its nearest center and the distance to it.

    Up to ``local_values`` doubles, the centers are one array value next to the points, which are
    neither joined nor shuffled. A larger table is cut into rings around anchors: each point meets the
    rings that can hold its nearest center, and the least of their best centers is the answer.
    """
    centers, n, d = _measured(_typed(centers), local_values)
    if n * d > local_values:
        return _assign_by_rings(points, centers, n, d, local_values)

    every = centers.agg(F.collect_list(F.struct("cluster", "center"))).scalar()
    return (
        points.withColumn("_centers", every)
        .withColumn("_best", _nearest("features", "_centers", d))
        .select("_best.cluster", "_best.distance", "id", "label", "features")
    )


def _assign_by_rings(points: DataFrame, centers: DataFrame, n: int, d: int, local_values: int) -> DataFrame:
    """Nearest center over the rings that a point meets.

    Different features are looked for once, among different centers of the lowest cluster each; the
    points meet the answer by their features. The joins are told, not left to estimated sizes, which
    do not count the rings of a point; a ring or features of many points are keys whose rows Spark splits.
    """
    different = centers.groupBy("center").agg(F.min("cluster").alias("cluster")).select("cluster", "center")
    rings = make_rings(different, n, d, local_values, max(1, min(RING_CENTERS, local_values // d)))
    points = points.select("id", "label", F.col("features").cast("array<double>").alias("features"))
    met = (
        with_rings(points.select("features").distinct(), rings)
        .select("features", F.explode("rings").alias("ring"))
        .join(rings.table.hint("merge"), "ring")
        .select("features", _nearest("features", "centers", d).alias("_nearest"))
    )
    best = met.groupBy(F.col("features").alias("_features")).agg(F.min("_nearest").alias("_best"))
    return points.join(best.hint("merge"), F.col("features") == F.col("_features")).select(
        "_best.cluster", "_best.distance", "id", "label", "features"
    )


def centers_frame(spark: SparkSession, rows: list) -> DataFrame:
    """Center table from ``(cluster, center)`` rows held by the driver, such as a fitted model's."""
    return spark.createDataFrame(
        [(int(c), [float(x) for x in center]) for c, center in rows], _CENTERS
    )


def center_distance(
    assigned: DataFrame, centers: DataFrame, local_values: int = LOCAL_CENTER_VALUES
) -> DataFrame:
    """Add the distance of each point to the center of the cluster it already belongs to.

    The centers are broadcast up to ``local_values`` doubles and joined as any table beyond.
    """
    centers, n, d = _measured(_typed(centers), local_values)
    if n * d <= local_values:
        centers = F.broadcast(centers)
    return (
        assigned.join(centers, "cluster")
        .withColumn("distance", euclidean("features", "center"))
        .select(*_ASSIGNED)
    )


def cluster_entropy(assigned: DataFrame) -> DataFrame:
    """One value ``score``: mean label entropy (bits) over the non-empty clusters, unweighted."""
    return str_entropy(assigned, ["cluster"], "label").agg(F.avg("entropy").alias("score"))


def cluster_distance(assigned: DataFrame) -> DataFrame:
    """One value ``score``: mean distance of all points to their own center."""
    return assigned.agg(F.avg("distance").alias("score"))


def best_k(scores: DataFrame) -> DataFrame:
    """The row ``(k, score)`` with the least score; equal scores: smallest k."""
    return scores.orderBy("score", "k").limit(1)


def top_per_cluster(assigned: DataFrame, top: int) -> DataFrame:
    """The ``top`` farthest points of each cluster; equal distances: lowest id first.

    A round over (cluster, salt) comes before the one over the cluster, so that one large cluster
    is never ranked by a single task, whatever ``top`` is.
    """
    salts = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    farthest = [F.desc("distance"), F.asc("id")]

    def ranked(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*farthest)
        return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= top).drop("_rank")

    salted = assigned.withColumn("_salt", F.pmod(F.xxhash64("id", "distance"), F.lit(salts)))
    return ranked(ranked(salted, "cluster", "_salt").drop("_salt"), "cluster")
