"""The text form of a matrix in files: one line per row, in order, written and read by many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strayline.operators.sparse import declared, looked_up
from strayline.sources.store import write_scratch


def write_matrix_lines(matrix: DataFrame, path: str) -> None:
    """Write ``(src_idx, dst_idx, p)`` cells as lines of cells joined by ``,``, in the order of rows.

    Rows are dealt out by ranges of their index and sorted in them, so that the files, in the order of
    their names, are the matrix. A task holds one line at a time; refused if the path exists.
    """
    cells = matrix.select("src_idx", "dst_idx", F.col("p").cast("string").alias("cell"))
    ordered = F.sort_array(F.collect_list(F.struct("dst_idx", "cell")))  # as many as there are states
    lines = cells.groupBy("src_idx").agg(F.array_join(F.transform(ordered, lambda c: c["cell"]), ",").alias("value"))
    lines.repartitionByRange("src_idx").sortWithinPartitions("src_idx").select("value").write.text(path)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(line, value)``, numbered from 0 over all files in the order of their names.

    A task reads stretches of files; a line's number is its place in its stretch and the lines of the
    stretches before that, which are one row each.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    lines = write_scratch(read)  # numbers and counts are of one reading
    stretches = lines.groupBy("file", "start").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    before = stretches.select(
        F.col("file").alias("_file"), F.col("start").alias("_start"), "_first", "_n",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start"))
    number: Column = F.col("_before") + F.col("at") - F.col("_first")
    return lines.join(F.broadcast(before), same).select(number.cast("int").alias("line"), "value")


def read_matrix_lines(
    spark: SparkSession, path: str, states: str | Sequence[str] | DataFrame
) -> DataFrame:
    """The cells ``(src, dst, src_idx, dst_idx, p)`` of a matrix written by `write_matrix_lines`.

    Rows or cells that are not as many as the states are an error.
    """
    domain, dim = declared(spark, states)
    ragged = F.raise_error(F.lit(f"matrix text does not have {dim} rows of as many cells"))
    lines = _numbered(spark, path)
    n = lines.agg(F.count(F.lit(1))).scalar()
    parts = F.split("value", ",")
    whole = F.when((F.size(parts) != dim) | (F.col("_n") != dim), ragged.cast("array<string>")).otherwise(parts)
    cells = lines.withColumn("_n", n).select(F.col("line").alias("src_idx"), F.posexplode(whole).alias("dst_idx", "cell"))
    for side in ("src", "dst"):
        named = domain.select(F.col("state").alias(side), F.col("idx").alias("_idx"))
        cells = looked_up(cells, named, F.col(f"{side}_idx") == F.col("_idx"), dim).drop("_idx")
    return cells.select("src", "dst", "src_idx", "dst_idx", F.col("cell").cast("double").alias("p"))
