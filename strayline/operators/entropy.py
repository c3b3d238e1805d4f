"""Entropies per group, aggregated in two steps that both combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strayline.functions import entropy_bits, entropy_nats


def str_entropy(df: DataFrame, group_cols: Sequence[str], column: str) -> DataFrame:
    """Entropy in bits of the values of ``column`` per group.

    Counting by (group, value) first spreads a large group over all tasks.
    """
    counts = df.groupBy(*group_cols, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*group_cols).agg(entropy_bits("_n").alias("entropy"))


def int_entropy(df: DataFrame, group_cols: Sequence[str], column: str) -> DataFrame:
    """Entropy in nats of the positive weights in ``column`` per group, 0 if there are none."""
    return df.groupBy(*group_cols).agg(entropy_nats(column).alias("entropy"))
