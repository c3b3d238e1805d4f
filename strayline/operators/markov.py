"""Transition support, transition matrix and the three metrics of a sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strayline.functions import entropy_term, outlier_flag
from strayline.operators.matrix import parse_states, state_grid, state_index
from strayline.operators.sparse import SparseMatrix, sparse_matrix, with_sparse_terms
from strayline.operators.sequences import (
    HOT_EVENTS,
    KEYS,
    PART_EVENTS,
    SEQUENCE,
    SplitEvents,
    all_steps,
    in_parts,
    ordered_steps,
    same_keys,
    sliced_steps,
    split_events,
    state_pairs,
)
from strayline.sources.store import write_scratch

METRICS = ("missprob", "missrate", "entreduc")
# A matrix of up to this many cells (about 100 MB) is broadcast to the scoring tasks.
BROADCAST_CELLS = 1_000_000
# Salts of a larger one: each of its rows is copied so often, and steps of one pair are dealt so far.
SALTS = 32


def transition_counts(events: DataFrame | SplitEvents) -> DataFrame:
    """Support of each observed step over all sequences: ``(src, dst, support)``."""
    return state_pairs(events).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("support"))


def transition_matrix(
    events: DataFrame | SplitEvents, states: str | Sequence[str], scale: float = 100
) -> DataFrame:
    """Transition matrix ``(src, dst, src_idx, dst_idx, support, p)`` over the declared states.

    A row in which some step was never seen gets 1 added in each of its cells. Each row is then
    scaled to the sum ``scale``; use ``scale=1`` for probabilities. ``support`` is the count
    before that correction. A step from or to an undeclared state is an error.

    The zero cells join the count as rows of weight 0, so grid and support take one aggregation.
    """
    names = parse_states(states)
    seen = state_pairs(events).select("src", "dst", F.lit(1).alias("n"))
    grid = state_grid(seen.sparkSession, names).select("src", "dst", F.lit(0).alias("n"))
    support = seen.unionByName(grid).groupBy("src", "dst").agg(F.sum("n").alias("support"))
    cells = support.select(
        "src",
        "dst",
        state_index(F.col("src"), names).alias("src_idx"),
        state_index(F.col("dst"), names).alias("dst_idx"),
        "support",
    )
    return scale_rows(cells, scale)


def sparse_transitions(
    events: DataFrame | SplitEvents, states: str | Sequence[str] | DataFrame, scale: float = 100
) -> SparseMatrix:
    """`transition_matrix` by its seen cells and one default per row, for any number of states."""
    return sparse_matrix(transition_counts(events), states, scale)


def scale_rows(cells: DataFrame, scale: float = 100) -> DataFrame:
    """Correct the rows that hold a zero and scale every row to the sum ``scale``."""
    row = Window.partitionBy("src_idx")
    corrected = F.col("support") + F.when(F.min("support").over(row) == 0, 1).otherwise(0)
    return cells.withColumn("_x", corrected).select(
        "src",
        "dst",
        "src_idx",
        "dst_idx",
        "support",
        (F.col("_x") * F.lit(float(scale)) / F.sum("_x").over(row)).alias("p"),
    )


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown strategy '{metric}', expected one of {', '.join(METRICS)}")
    return metric


def step_terms(matrix: DataFrame, states: Sequence[str], metric: str) -> DataFrame:
    """What each step adds to numerator and denominator of the metric: ``(_src, _dst, _num, _den)``.

    One row per matrix cell of the declared states, and one per source with ``_dst`` NULL for any
    other target, which counts as a cell of probability 0.
    """
    declared = matrix.where(F.col("src").isin(states) & F.col("dst").isin(states))
    row = Window.partitionBy("src")
    twice = F.raise_error(F.concat(F.lit("matrix cell given twice in row "), F.col("src")))
    distinct = F.size(F.collect_set("dst").over(row)) == F.count("dst").over(row)
    declared = declared.withColumn("p", F.when(distinct, F.col("p")).otherwise(twice.cast("double")))
    cells = declared.select(
        "src",
        F.sum("p").over(row).alias("row_sum"),
        F.sum(entropy_term("p")).over(row).alias("row_entropy"),
        F.min_by("dst", F.struct(-F.col("p"), F.col("dst_idx"))).over(row).alias("best"),
        F.min("dst_idx").over(row).alias("first_idx"),
        "dst_idx",
        F.struct("dst", "p").alias("cell"),
    )
    other = F.struct(F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("p"))
    at_first = F.col("dst_idx") == F.col("first_idx")
    cells = cells.withColumn(
        "cell", F.explode(F.when(at_first, F.array("cell", other)).otherwise(F.array("cell")))
    )
    dst, p = F.col("cell.dst"), F.col("cell.p")
    terms = {
        "missprob": (F.col("row_sum") - p, F.lit(1.0)),
        "missrate": (F.when(dst.eqNullSafe(F.col("best")), 0.0).otherwise(1.0), F.lit(1.0)),
        "entreduc": (F.col("row_entropy") - entropy_term(p), F.col("row_entropy")),
    }
    num, den = terms[check_metric(metric)]
    return cells.select(
        F.col("src").alias("_src"), dst.alias("_dst"), num.alias("_num"), den.alias("_den")
    )


def _with_terms(steps: DataFrame, terms: DataFrame, states: Sequence[str]) -> DataFrame:
    """Add the columns ``num`` and ``den``: NULL for a row that is no step.

    A step takes one lookup, whatever the number of states. The lookup table has exactly
    ``n * (n + 1)`` rows for ``n`` declared states and is broadcast up to a fixed size. Beyond, the
    steps meet it by pair and salt, so that a frequent pair is dealt over SALTS tasks. A source
    state without a matrix row, or a declared target without its cell, is an error.
    """
    target = F.when(F.col("state").isin(states), F.col("state"))
    steps_at = steps.withColumn("_prev", F.col("prev.state")).withColumn("_target", target)
    same = (F.col("_prev") == F.col("_src")) & F.col("_target").eqNullSafe(F.col("_dst"))
    if len(states) ** 2 <= BROADCAST_CELLS:
        terms = F.broadcast(terms)
    else:
        salt = F.pmod(F.hash(*KEYS, "pos"), F.lit(SALTS))
        steps_at = steps_at.withColumn("_step_salt", salt)
        # told to merge: the estimated size does not count the copies, and might be broadcast
        terms = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        same = same & (F.col("_step_salt") == F.col("_salt"))
    looked = steps_at.join(terms, same, "left")
    pair = F.concat_ws(" > ", F.coalesce("_prev", F.lit("NULL")), "_target")
    message = F.when(F.col("_prev").isin(states), "no matrix cell for step: ").otherwise("state not declared: ")
    failed = F.col("prev").isNotNull() & F.col("_src").isNull()
    return looked.select(
        *steps.columns,
        F.when(failed, F.raise_error(F.concat(message, pair)).cast("double"))
        .otherwise(F.col("_num")).alias("num"),
        F.col("_den").alias("den"),
    )


def _scored(
    steps: DataFrame, matrix: DataFrame | SparseMatrix, states: str | Sequence[str] | None, metric: str, only_seen: bool
) -> DataFrame:
    """Steps with ``num`` and ``den``, by either form of matrix."""
    if isinstance(matrix, SparseMatrix):
        return with_sparse_terms(steps, matrix, check_metric(metric), only_seen)
    names = parse_states(states)
    return _with_terms(steps, step_terms(matrix, names, metric), names)


def _metric(num: Column, den: Column) -> Column:
    """NULL (not NaN) for a sequence without a step."""
    return F.try_divide(num, den)


def sequence_metrics(
    events: DataFrame | SplitEvents,
    matrix: DataFrame | SparseMatrix,
    states: str | Sequence[str] | None,
    metric: str,
    only_seen: bool = False,
) -> DataFrame:
    """One row ``(site, user, metric)`` per sequence; NULL for a sequence of one event.

    - ``missprob``: mean over the steps of the row's sum without the actual target
    - ``missrate``: share of steps whose target is not the row's most likely one
    - ``entreduc``: entropy of the rows without the actual target over their whole entropy, summed
      over the steps before dividing

    The matrix enters as it is, so ``missprob`` ranges over 0..scale of the matrix. A sparse one
    brings its states; ``only_seen`` says that it was learned from these events.
    """
    scored = _scored(all_steps(events), matrix, states, metric, only_seen)
    metrics = scored.groupBy(*KEYS).agg(_metric(F.sum("num"), F.sum("den")).alias("metric"))
    return metrics.select(*SEQUENCE, "metric")


def miss_prob(events, matrix: DataFrame, states) -> DataFrame:
    return sequence_metrics(events, matrix, states, "missprob")


def miss_rate(events, matrix: DataFrame, states) -> DataFrame:
    return sequence_metrics(events, matrix, states, "missrate")


def entropy_reduction(events, matrix: DataFrame, states) -> DataFrame:
    return sequence_metrics(events, matrix, states, "entreduc")


def score_sequences(
    events: DataFrame | SplitEvents,
    matrix: DataFrame | SparseMatrix,
    states: str | Sequence[str] | None,
    metric: str,
    threshold: float,
    part_events: int = PART_EVENTS,
    hot_events: int = HOT_EVENTS,
    only_seen: bool = False,
) -> DataFrame:
    """Score and flag every sequence: ``(site, user, part, states, metric, flag)``.

    All sequences are returned, flagged ``yes`` if the metric is above the threshold. The states
    come in parts (see `build_sequences`); metric and flag stand in the row of part 0, once per
    sequence whatever its length, and are NULL in the rows that continue its states.

    Events are shuffled once: order, lookups, parts and the sums per sequence all work on the
    partitioning by (site, user). The parts of hot sequences are written once with their sums,
    from which the totals come.
    """
    split = split_events(events, hot_events)
    sums = [F.sum("num").alias("num"), F.sum("den").alias("den")]
    first = F.col("part") == 0

    whole = Window.partitionBy(*KEYS)
    total = _metric(F.sum("num").over(whole), F.sum("den").over(whole))
    columns = [*SEQUENCE, "part", "states", F.when(first, F.col("metric")).alias("metric")]
    parts = in_parts(_scored(ordered_steps(split.cold, KEYS), matrix, states, metric, only_seen), part_events, *sums)
    scored = parts.withColumn("metric", total).select(*columns)
    if split.hot is not None:
        parts = write_scratch(
            in_parts(_scored(sliced_steps(split.hot), matrix, states, metric, only_seen), part_events, *sums)
        )
        totals = parts.groupBy(*KEYS).agg(_metric(F.sum("num"), F.sum("den")).alias("metric"))
        totals = totals.select(*[F.col(c).alias(f"_of_{c}") for c in KEYS], "metric")
        hot = parts.join(totals, first & same_keys("", "_of_", KEYS), "left")
        scored = scored.unionByName(hot.select(*columns))
    flag = F.when(first, outlier_flag("metric", threshold))
    return scored.withColumn("flag", flag)
