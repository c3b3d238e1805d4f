"""Matrices in long form: one row ``(src, dst, src_idx, dst_idx, p)`` per cell.

The state list fixes the order of rows and columns; its length squared is the exact row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strayline.functions import entropy_term


def parse_states(states: str | Sequence[str]) -> list[str]:
    """State list from a comma-separated text or a sequence; order defines the index."""
    parsed = states.split(",") if isinstance(states, str) else list(states)
    if not parsed or len(set(parsed)) != len(parsed):
        raise ValueError("states must be a non-empty list without repetitions")
    return parsed


def states_array(states: Sequence[str]) -> Column:
    return F.array(*[F.lit(s) for s in states])


def state_domain(spark: SparkSession, states: str | Sequence[str]) -> DataFrame:
    """The declared states as ``(state, idx)``."""
    every = states_array(parse_states(states))
    return spark.range(1).select(F.posexplode(every).alias("idx", "state")).select("state", "idx")


def state_index(state: Column, states: Sequence[str]) -> Column:
    """Index of a state in the declared list; an undeclared state ends the query with an error."""
    at = F.coalesce(F.array_position(states_array(states), state), F.lit(0))
    unknown = F.concat(F.lit("state not declared: "), F.coalesce(state, F.lit("NULL")))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(unknown).cast("int"))


def state_grid(spark: SparkSession, states: Sequence[str]) -> DataFrame:
    """All cells ``(src, dst, src_idx, dst_idx)``, generated in parallel from a cell number."""
    dim = len(states)
    names = states_array(states)
    cells = spark.range(dim * dim).select(
        F.floor(F.col("id") / dim).cast("int").alias("src_idx"),
        (F.col("id") % dim).cast("int").alias("dst_idx"),
    )
    return cells.select(
        F.get(names, F.col("src_idx")).alias("src"),
        F.get(names, F.col("dst_idx")).alias("dst"),
        "src_idx",
        "dst_idx",
    )


def row_stats(matrix: DataFrame) -> DataFrame:
    """Per row: sum, minimum, maximum, state of the maximum (equal: lowest index), entropy."""
    return matrix.groupBy("src").agg(
        F.sum("p").alias("row_sum"),
        F.min("p").alias("row_min"),
        F.max("p").alias("row_max"),
        F.min_by("dst", F.struct(-F.col("p"), F.col("dst_idx"))).alias("best"),
        F.sum(entropy_term("p")).alias("row_entropy"),
    )


def row_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("src").agg(F.sum("p").alias("row_sum"))


def column_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("dst").agg(F.sum("p").alias("col_sum"))


def matrix_cell(matrix: DataFrame, src: str, dst: str) -> DataFrame:
    """One cell, found by its labels."""
    return matrix.where((F.col("src") == src) & (F.col("dst") == dst))


def matrix_row(matrix: DataFrame, src: str) -> DataFrame:
    """One row, found by its label, in column order."""
    return matrix.where(F.col("src") == src).orderBy("dst_idx")


def matrix_add(matrix: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add ``(src, dst, p)`` deltas to the cells they name; an unknown cell is an error."""
    cells = matrix.select("src", "dst", "src_idx", "dst_idx", "p").unionByName(
        deltas.select("src", "dst", "p"), allowMissingColumns=True
    )
    summed = cells.groupBy("src", "dst").agg(
        F.max("src_idx").alias("src_idx"), F.max("dst_idx").alias("dst_idx"), F.sum("p").alias("p")
    )
    known = F.col("src_idx").isNotNull()
    unknown = F.concat_ws(" ", F.lit("no such cell:"), "src", "dst")
    return summed.select(
        "src", "dst", "src_idx", "dst_idx",
        F.when(known, F.col("p")).otherwise(F.raise_error(unknown).cast("double")).alias("p"),
    )


def matrix_increment(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """Add 1 to a cell for each row ``(src, dst)`` that names it."""
    return matrix_add(matrix, cells.select("src", "dst", F.lit(1.0).alias("p")))


def matrix_set(matrix: DataFrame, values: DataFrame) -> DataFrame:
    """Overwrite the cells named by ``(src, dst, p)``; a cell that the matrix lacks or that is named
    twice is an error."""
    new = values.groupBy("src", "dst").agg(F.max("p").alias("_new"), F.count("*").alias("_n"))
    joined = matrix.join(new, ["src", "dst"], "full")
    cell = F.concat_ws(" -> ", "src", "dst")
    unknown = F.raise_error(F.concat(F.lit("no such cell: "), cell)).cast("double")
    twice = F.raise_error(F.concat(F.lit("cell set twice: "), cell)).cast("double")
    p = (
        F.when(F.col("src_idx").isNull(), unknown)
        .when(F.col("_n") > 1, twice)
        .when(F.col("_n") == 1, F.col("_new"))
        .otherwise(F.col("p"))
    )
    return joined.select("src", "dst", "src_idx", "dst_idx", p.alias("p"))


def matrix_to_string(matrix: DataFrame) -> DataFrame:
    """The matrix as one text ``matrix``: cells joined by ``,`` and rows by ``;``."""
    def joined(idx: str, text: str, sep: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct(idx, text)))
        return F.array_join(F.transform(ordered, lambda c: c[text]), sep)

    cells = matrix.select("src_idx", "dst_idx", F.col("p").cast("string").alias("cell"))
    rows = cells.groupBy("src_idx").agg(joined("dst_idx", "cell", ",").alias("line"))
    return rows.agg(joined("src_idx", "line", ";").alias("matrix"))


def matrix_from_string(df: DataFrame, states: str | Sequence[str], column: str = "matrix") -> DataFrame:
    """Read the text form back, with the labels of ``states``; rows or cells that are not as many
    as the states are an error."""
    labels = parse_states(states)
    names = states_array(labels)

    def parts(text: str, sep: str) -> Column:
        found = F.split(text, sep)
        ragged = F.raise_error(F.lit(f"matrix text does not have {len(labels)} rows of as many cells"))
        return F.when(F.size(found) != len(labels), ragged.cast("array<string>")).otherwise(found)

    rows = df.select(F.posexplode(parts(column, ";")).alias("src_idx", "line"))
    cells = rows.select("src_idx", F.posexplode(parts("line", ",")).alias("dst_idx", "cell"))
    return cells.select(
        F.get(names, F.col("src_idx")).alias("src"),
        F.get(names, F.col("dst_idx")).alias("dst"),
        "src_idx",
        "dst_idx",
        F.col("cell").cast("double").alias("p"),
    )
