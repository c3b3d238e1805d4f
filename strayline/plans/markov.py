"""Behavior detector: learn the transition matrix, then score the same sequences by it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from strayline.operators.markov import check_metric, score_sequences, sparse_transitions
from strayline.operators.sequences import split_events


def find_markov_outliers(
    events: DataFrame,
    states: str | Sequence[str] | DataFrame,
    *,
    scale: float = 100,
    strategy: str,
    threshold: float,
) -> DataFrame:
    """All sequences with metric and flag: ``(site, user, part, states, metric, flag)``.

    Training and scoring order the events by the same shuffle, which Spark runs once. The matrix has
    the seen cells and a default per row, so that many states, given as a table ``(state, idx)``,
    do not make as many cells as pairs of them.
    """
    check_metric(strategy)
    split = split_events(events)
    matrix = sparse_transitions(split, states, scale)
    return score_sequences(split, matrix, None, strategy, threshold, only_seen=True)
