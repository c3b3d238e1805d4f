"""Feature cells, points, per-feature statistics and z-scores.

A *point* is ``(id LONG, label STRING, features ARRAY<DOUBLE>)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strayline.operators.moments import exact_moments


def assemble_points(cells: DataFrame) -> DataFrame:
    """Long-form cells ``(row, col, lbl, val)`` to one dense point per row, ordered by column.

    Every row must hold each column exactly once. The dimension is the number of distinct columns,
    from a read of ``col`` alone. A row's cells are numbered in sorted order before they are
    collected, so the array built for one row never exceeds the dimension, and a row with surplus
    or missing cells ends the query with an error.
    """
    dim = cells.select("col").distinct().agg(F.count(F.lit(1))).scalar()
    unequal = F.raise_error(F.lit("points have vectors of unequal length"))
    numbered = cells.withColumn("_dim", dim).withColumn(
        "_nr", F.row_number().over(Window.partitionBy("row").orderBy("col"))
    )
    within = F.when(F.col("_nr") <= F.col("_dim"), F.col("val")).otherwise(unequal.cast("double"))
    gathered = numbered.withColumn("val", within).groupBy(F.col("row").alias("id")).agg(
        F.min_by("lbl", "col").alias("label"),
        F.sort_array(F.collect_list(F.struct("col", "val"))).alias("cells"),
        F.count("val").alias("filled"),
        F.max("_dim").alias("dim"),
    )
    distinct_cols = F.size(F.array_distinct(F.transform("cells", lambda c: c["col"])))
    complete = (distinct_cols == F.size("cells")) & (F.col("filled") == F.size("cells"))
    return gathered.select(
        "id",
        "label",
        F.when(F.size("cells") < F.col("dim"), unequal.cast("array<double>"))
        .when(complete, F.transform("cells", lambda c: c["val"]))
        .otherwise(F.raise_error(F.concat(
            F.lit("cell given twice or without value in row "), F.col("id").cast("string"))))
        .alias("features"),
    )


def feature_stats(points: DataFrame) -> DataFrame:
    """Per feature: ``(pos, n, total, mean, stdev)`` with the population standard deviation.

    The figures are exact sums, rounded once: the same in every order and partitioning of the points.
    Raises if the vectors differ in length.
    """
    stats = exact_moments(points)
    most = F.max("n").over(Window.partitionBy())  # one row per feature
    unequal = F.raise_error(F.lit("points have vectors of unequal length: no common dimension")).cast("long")
    n = F.when(F.col("n") == most, F.col("n")).otherwise(unequal)
    return stats.select("pos", n.alias("n"), "total", "mean", "stdev")


def zscore(points: DataFrame) -> DataFrame:
    """Replace every feature by its z-score; a constant feature is only centered.

    The statistics (two values per feature) come in as a scalar subquery: the points are not
    joined or shuffled.
    """
    spread = F.when(F.col("stdev") > 0, F.col("stdev")).otherwise(1.0)
    of_feature = F.struct("pos", F.when(F.col("n") > 0, F.col("mean")).alias("mean"), spread.alias("spread"))
    stats = feature_stats(points).agg(F.sort_array(F.collect_list(of_feature))).scalar()
    scaled = F.zip_with("features", "_stats", lambda x, s: (x - s["mean"]) / s["spread"])
    return points.withColumn("_stats", stats).select("id", "label", scaled.alias("features"))
