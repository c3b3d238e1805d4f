"""Transition matrices over many states: the cells that were seen, and one default value per row.

The correction of a row that holds a zero gives all of its unseen cells the same value. So a row is
its seen cells, that value and how many cells have it; sums, entropies and best targets follow, and
nothing has as many rows as there are pairs of states.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strayline.functions import entropy_term
from strayline.operators.matrix import parse_states

# A lookup table of up to this many rows (about 10 MB) is broadcast: a query has up to five of them, and
# the driver builds each.
BROADCAST_ROWS = 100_000


class SparseMatrix(NamedTuple):
    """A matrix over the declared ``states``, a table ``(state, idx)`` of ``dim`` rows.

    - ``cells``: ``(src, dst, src_idx, dst_idx, support, p)`` of the pairs that were seen, and of
      their rows ``row_sum, best, row_entropy``
    - ``rows``: ``(src, src_idx, rest, n_rest, row_sum, row_min, row_max, best, row_entropy)`` of
      every declared state; ``rest`` is the value of each of the ``n_rest`` unseen cells of the row
    """

    cells: DataFrame
    rows: DataFrame
    states: DataFrame
    dim: int


def declared(spark: SparkSession, states: str | Sequence[str] | DataFrame) -> tuple[DataFrame, int]:
    """The states as a table ``(state, idx)`` and their number; a table is taken as it is.

    A state or an index that is declared twice, or an index that is none of 0 to n-1, is an error.
    """
    if isinstance(states, DataFrame):
        told = states.select("state", F.col("idx").cast("int").alias("idx"))
        seen = told.agg(
            F.count("*").alias("n"), F.count_distinct("state").alias("states"),
            F.count_distinct("idx").alias("places"), F.min("idx").alias("low"), F.max("idx").alias("high"),
        ).first()
        n = seen["n"]
        if not n or (seen["states"], seen["places"], seen["low"], seen["high"]) != (n, n, 0, n - 1):
            raise ValueError("states must be a non-empty table without repetitions, numbered from 0")
        return told, n
    names = parse_states(states)
    every = F.from_json(F.lit(json.dumps(names)), "array<string>")
    return spark.range(1).select(F.posexplode(every).alias("idx", "state")).select("state", "idx"), len(names)


def looked_up(rows: DataFrame, table: DataFrame, same: Column, size: int) -> DataFrame:
    """``rows`` with what ``table``, of at most ``size`` rows, has for each of them.

    The table is broadcast up to BROADCAST_ROWS. Beyond, rows meet it by key in a sort-merge join, in
    which Spark splits the rows of a frequent key. The join is told, not left to estimated sizes: those
    take a large table of few bytes in its file for one that can be broadcast.
    """
    return rows.join(F.broadcast(table) if size <= BROADCAST_ROWS else table.hint("merge"), same, "left")


def _indexed(counts: DataFrame, states: DataFrame, dim: int) -> DataFrame:
    """Counts with the indices of both states; an undeclared one is an error."""
    for side in ("src", "dst"):
        known = states.select(F.col("state").alias("_state"), F.col("idx").alias("_idx"))
        counts = looked_up(counts, known, F.col(side) == F.col("_state"), dim)
        message = F.concat(F.lit("state not declared: "), F.coalesce(F.col(side), F.lit("NULL")))
        # in the state itself, as an index that nobody reads is not computed
        known = F.when(F.col("_idx").isNull(), F.raise_error(message).cast("string")).otherwise(F.col(side))
        counts = counts.withColumn(side, known).withColumnRenamed("_idx", f"{side}_idx").drop("_state")
    return counts


def sparse_matrix(
    counts: DataFrame, states: str | Sequence[str] | DataFrame, scale: float = 100
) -> SparseMatrix:
    """The matrix of the support ``(src, dst, support)`` over the declared states.

    As `transition_matrix`: a row in which some step was never seen gets 1 added in each of its
    cells, and each row is then scaled to the sum ``scale``.
    """
    domain, dim = declared(counts.sparkSession, states)
    whole = float(scale)
    row = Window.partitionBy("src")
    seen = F.count(F.lit(1)).over(row)
    corrected = _indexed(counts, domain, dim).select("*", seen.alias("_seen"), F.when(seen < dim, 1).otherwise(0).alias("_added"))
    # an added 1 in the cells that were not seen counts in the sum too
    total = F.sum("support").over(row) + F.col("_added") * dim
    scaled = (F.col("support") + F.col("_added")) * F.lit(whole)
    filled = corrected.withColumn("_total", total).withColumn("p", scaled / F.col("_total")).withColumn(
        "_rest", F.when(F.col("_added") > 0, F.lit(whole) / F.col("_total"))
    )
    n_rest = F.lit(dim) - F.col("_seen")

    def with_rest(of_seen: Column, of_rest: Column) -> Column:
        return of_seen + F.coalesce(of_rest * n_rest, F.lit(0.0))

    cells = filled.select(
        "src", "dst", "src_idx", "dst_idx", "support", "p",
        with_rest(F.sum("p").over(row), F.col("_rest")).alias("row_sum"),
        F.min_by("dst", F.struct(-F.col("p"), F.col("dst_idx"))).over(row).alias("best"),
        with_rest(F.sum(entropy_term("p")).over(row), entropy_term("_rest")).alias("row_entropy"),
        "_rest", "_seen",
    )
    sums = cells.groupBy("src").agg(
        F.min("p").alias("_min"), F.max("p").alias("_max"),
        *[F.first(c).alias(f"_of_{c}") for c in ("_rest", "_seen", "row_sum", "best", "row_entropy")],
    )
    every = domain.select(F.col("state").alias("_state"), F.col("idx").alias("src_idx"))
    first = domain.where("idx = 0").select("state").scalar()
    unseen = F.col("src").isNull()
    alike = F.lit(whole) / dim  # the value of all cells of a row without any that was seen
    # a seen cell is always greater than an unseen one of its row
    rows = every.join(sums, F.col("_state") == F.col("src"), "left").withColumn("_first", first).select(
        F.col("_state").alias("src"), "src_idx",
        F.when(unseen, alike).otherwise(F.col("_of__rest")).alias("rest"),
        (F.lit(dim) - F.coalesce("_of__seen", F.lit(0))).alias("n_rest"),
        F.coalesce("_of_row_sum", F.lit(whole)).alias("row_sum"),
        F.when(unseen, alike).otherwise(F.coalesce("_of__rest", "_min")).alias("row_min"),
        F.coalesce("_max", alike).alias("row_max"),
        F.coalesce("_of_best", "_first").alias("best"),
        F.coalesce("_of_row_entropy", entropy_term(alike) * dim).alias("row_entropy"),
    )
    return SparseMatrix(cells.drop("_rest", "_seen"), rows, domain, dim)


def sparse_row_stats(matrix: SparseMatrix) -> DataFrame:
    """As `row_stats` of the whole matrix."""
    return matrix.rows.select("src", "row_sum", "row_min", "row_max", "best", "row_entropy")


def sparse_column_sums(matrix: SparseMatrix) -> DataFrame:
    """As `column_sums` of the whole matrix: what all rows have in an unseen cell, and per column
    what its seen cells have more than that."""
    all_rest = matrix.rows.agg(F.sum("rest").alias("rest")).select(F.coalesce("rest", F.lit(0.0))).scalar()
    rest = matrix.rows.select(F.col("src").alias("_src"), F.col("rest").alias("_rest"))
    cells = looked_up(matrix.cells, rest, F.col("src") == F.col("_src"), matrix.dim)
    more = cells.groupBy(F.col("dst").alias("_dst")).agg(
        F.sum(F.col("p") - F.coalesce("_rest", F.lit(0.0))).alias("_more")
    )
    columns = matrix.states.join(more, F.col("state") == F.col("_dst"), "left").withColumn("_all", all_rest)
    return columns.select(
        F.col("state").alias("dst"), (F.col("_all") + F.coalesce("_more", F.lit(0.0))).alias("col_sum")
    )


def sparse_row(matrix: SparseMatrix, src: str) -> DataFrame:
    """One row with all of its cells, in column order: ``(src, dst, src_idx, dst_idx, support, p)``."""
    seen = matrix.cells.where(F.col("src") == src).select(F.col("dst").alias("_dst"), "support", "p")
    row = matrix.rows.where(F.col("src") == src).select(F.struct("src", "src_idx", "rest")).scalar()
    cells = matrix.states.select(F.col("state").alias("dst"), F.col("idx").alias("dst_idx"), row.alias("row"))
    return cells.where("row is not null").join(seen, F.col("dst") == F.col("_dst"), "left").select(
        "row.src", "dst", "row.src_idx", "dst_idx", F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("p", "row.rest").alias("p"),
    ).orderBy("dst_idx")


def sparse_terms(matrix: SparseMatrix, metric: str) -> tuple[DataFrame, DataFrame]:
    """What a step adds to numerator and denominator of a metric.

    ``(_src, _dst, _num, _den)`` per seen cell, and ``(_row, _rest_num, _other_num, _row_den)`` per
    row: for an unseen cell, and for an undeclared target, which counts as a cell of probability 0.
    """
    def num(p: Column, dst: Column) -> Column:
        return {
            "missprob": F.col("row_sum") - p,
            "missrate": F.when(dst.eqNullSafe(F.col("best")), 0.0).otherwise(1.0),
            "entreduc": F.col("row_entropy") - entropy_term(p),
        }[metric]

    den = F.col("row_entropy") if metric == "entreduc" else F.lit(1.0)
    seen = matrix.cells.select(
        F.col("src").alias("_src"), F.col("dst").alias("_dst"), num(F.col("p"), F.col("dst")).alias("_num"), den.alias("_den")
    )
    nothing = F.lit(None).cast("string")
    unseen = matrix.rows.select(
        F.col("src").alias("_row"), num(F.col("rest"), nothing).alias("_rest_num"),
        num(F.lit(0.0), nothing).alias("_other_num"), den.alias("_row_den"),
        F.when(F.col("n_rest") == F.lit(matrix.dim), F.col("best")).alias("_best_unseen"),
    )
    return seen, unseen


def with_sparse_terms(
    steps: DataFrame, matrix: SparseMatrix, metric: str, only_seen: bool = False
) -> DataFrame:
    """Steps with the columns ``num`` and ``den``: NULL for a row that is no step.

    ``only_seen`` says that the matrix was learned from these steps, so that each has its cell and
    one lookup is enough. Else a step without a cell takes the value of its row: that of an unseen
    cell if its target is declared, that of probability 0 if not. A source state that was not
    declared is an error.
    """
    seen, unseen = sparse_terms(matrix, metric)
    n_cells = matrix.dim**2
    if n_cells > BROADCAST_ROWS:
        n_cells = matrix.cells.count()
    looked = steps.withColumn("_prev", F.col("prev.state"))
    looked = looked_up(looked, seen, (F.col("_prev") == F.col("_src")) & (F.col("state") == F.col("_dst")), n_cells)
    pair = F.concat_ws(" > ", F.coalesce("_prev", F.lit("NULL")), "state")
    is_step = F.col("prev").isNotNull()
    if only_seen:
        lost = F.raise_error(F.concat(F.lit("no matrix cell for step: "), pair)).cast("double")
        num = F.when(is_step & F.col("_src").isNull(), lost).otherwise(F.col("_num"))
        return looked.select(*steps.columns, num.alias("num"), F.col("_den").alias("den"))
    targets = matrix.states.select(F.col("state").alias("_target"))
    looked = looked_up(looked, unseen, F.col("_prev") == F.col("_row"), matrix.dim)
    looked = looked_up(looked, targets, F.col("state") == F.col("_target"), matrix.dim)
    unknown = F.raise_error(F.concat(F.lit("state not declared: "), pair)).cast("double")
    rest = F.col("_rest_num")
    if metric == "missrate":  # in a row without any seen cell the first state is the best one
        rest = F.when(F.col("_target").eqNullSafe(F.col("_best_unseen")), 0.0).otherwise(rest)
    num = (
        F.when(is_step & F.col("_row").isNull(), unknown)
        .when(F.col("_src").isNotNull(), F.col("_num"))
        .when(F.col("_target").isNotNull(), rest)
        .otherwise(F.col("_other_num"))
    )
    den = F.coalesce("_den", "_row_den")
    return looked.select(*steps.columns, F.when(is_step, num).alias("num"), F.when(is_step, den).alias("den"))


def dense(matrix: SparseMatrix) -> DataFrame:
    """All cells ``(src, dst, src_idx, dst_idx, support, p)``: as many rows as pairs of states."""
    grid = matrix.states.sparkSession.range(matrix.dim**2).select(
        F.floor(F.col("id") / matrix.dim).cast("int").alias("src_idx"),
        (F.col("id") % matrix.dim).cast("int").alias("dst_idx"),
    )
    names = matrix.states.select(F.col("state").alias("dst"), F.col("idx").alias("dst_idx"))
    seen = matrix.cells.select("src_idx", "dst_idx", "support", "p")
    whole = grid.join(matrix.rows.select("src", "src_idx", "rest"), "src_idx").join(names, "dst_idx")
    return whole.join(seen, ["src_idx", "dst_idx"], "left").select(
        "src", "dst", "src_idx", "dst_idx", F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("p", "rest").alias("p"),
    )
