"""Ordered state sequences and their consecutive pairs.

A *state event* is ``(site, user, timestamp, state)``, optionally with a ``tiebreak`` column that
orders events of the same timestamp (without it, the state does). All events of one (site, user)
form a sequence.

Ordering a sequence needs its rows in one place. To keep that true for a sequence that holds a
large part of all rows, such *hot* sequences are found by a count first and cut into slices of
their order; slices are ordered on their own, and each gets the position it starts at and the
state before it from the sizes and last states of the slices. So a step has the same position
and the same previous state on both paths.
"""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from strayline.sources.store import write_scratch

# A sequence of more events than this is cut into slices of about this many.
HOT_EVENTS = 1_000_000
# Longest array of states in one row of `build_sequences`.
PART_EVENTS = 10_000

# The user leads: it tells rows apart in the first bytes that a sort compares.
KEYS = ["user", "site"]
SEQUENCE = ["site", "user"]


class SplitEvents(NamedTuple):
    """Events apart by the size of their sequence; ``hot`` is None if no sequence is hot.

    A hot event has the number of its ``slice``, the position at which the slice starts in its
    sequence, and the state before it: ``start, before``.
    """

    cold: DataFrame
    hot: DataFrame | None


def same_keys(a: str, b: str, columns: list[str]) -> Column:
    """Equal sequence keys in columns with the prefixes ``a`` and ``b``; NULL equals NULL."""
    parts = [F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in columns]
    same = parts[0]
    for part in parts[1:]:
        same = same & part
    return same


def split_events(events: DataFrame | SplitEvents, hot_events: int = HOT_EVENTS) -> SplitEvents:
    """Separate the sequences of more than ``hot_events`` events and give their events a ``slice``.

    Slices are ranges of the whole order, so that events of one timestamp are cut too; events
    equal in all of it are interchangeable and told apart by a random number. The sliced events
    are written to the shared folder once, for every later step has to see the same slices. The
    table of hot sequences stays a DataFrame: at most one row per ``hot_events`` events.
    """
    if isinstance(events, SplitEvents):
        return events
    sizes = events.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.where(F.col("n") > hot_events)
    keys = keys.select(*[F.col(c).alias(f"_hot_{c}") for c in KEYS], "n").persist()
    found = keys.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("events")).first()
    if not found["keys"]:
        keys.unpersist()
        return SplitEvents(events, None)
    is_hot = same_keys("", "_hot_", KEYS)
    slices = ceil(found["events"] / hot_events)
    ranged = (
        events.join(keys, is_hot, "left_semi")
        .withColumn("_salt", F.rand(0))
        .repartitionByRange(slices, *KEYS, *order_names(events), "_salt")
    )
    hot = write_scratch(ranged.withColumn("slice", F.spark_partition_id()).drop("_salt"))
    return SplitEvents(events.join(keys, is_hot, "left_anti"), _with_starts(hot))


def _with_starts(hot: DataFrame) -> DataFrame:
    """Add ``start`` and ``before`` of the slices, a written table whose size Spark knows when it
    chooses the join."""
    at = F.struct(*order_names(hot))
    ends = hot.groupBy(*KEYS, "slice").agg(
        F.count(F.lit(1)).alias("n"), F.struct(F.max(at)["state"].alias("state")).alias("last")
    )
    w = Window.partitionBy(*KEYS).orderBy("slice")
    earlier = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    keys = [*KEYS, "slice"]
    starts = write_scratch(
        ends.select(
            *[F.col(c).alias(f"_of_{c}") for c in keys],
            F.coalesce(earlier, F.lit(0)).alias("start"),
            F.lag("last").over(w).alias("before"),
        )
    )
    return hot.join(starts, same_keys("", "_of_", keys)).select(*hot.columns, "start", "before")


def order_names(events: DataFrame) -> list[str]:
    """The columns that order the events of a sequence."""
    return [c for c in ("timestamp", "tiebreak", "state") if c in events.columns]


def ordered_steps(events: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Each event with its position and a struct of the state before it (NULL at the start)."""
    w = Window.partitionBy(*keys).orderBy(*[F.asc(c) for c in order_names(events)])
    return events.select(
        *keys,
        "state",
        (F.row_number().over(w) - 1).cast("long").alias("pos"),
        F.lag(F.struct("state")).over(w).alias("prev"),
        *more,
    )


def sliced_steps(hot: DataFrame) -> DataFrame:
    """`ordered_steps` of hot sequences, positions and previous states across all slices."""
    return ordered_steps(hot, [*KEYS, "slice"], "start", "before").select(
        *KEYS,
        "state",
        (F.col("start") + F.col("pos")).alias("pos"),
        F.coalesce("prev", "before").alias("prev"),
    )


def all_steps(events: DataFrame | SplitEvents, hot_events: int = HOT_EVENTS) -> DataFrame:
    """Every step ``(user, site, state, pos, prev)``; a sequence's first event has no ``prev``."""
    split = split_events(events, hot_events)
    steps = ordered_steps(split.cold, KEYS)
    return steps if split.hot is None else steps.unionByName(sliced_steps(split.hot))


def state_pairs(events: DataFrame | SplitEvents, hot_events: int = HOT_EVENTS) -> DataFrame:
    """Consecutive states of all sequences: ``(site, user, src, dst)``, one row per step."""
    steps = all_steps(events, hot_events).where(F.col("prev").isNotNull())
    return steps.select(*SEQUENCE, F.col("prev.state").alias("src"), F.col("state").alias("dst"))


def in_parts(steps: DataFrame, part_events: int, *sums: Column) -> DataFrame:
    """Steps gathered into ``(user, site, part, states)`` and the given aggregates.

    ``part`` is ``floor(pos / part_events)``. Cold steps are partitioned by (user, site), which
    these groups extend: they need no further shuffle.
    """
    gathered = F.sort_array(F.collect_list(F.struct("pos", "state")))
    states = F.transform(gathered, lambda e: e["state"]).alias("states")
    part = F.floor(F.col("pos") / part_events)
    return steps.withColumn("part", part).groupBy(*KEYS, "part").agg(states, *sums)


def build_sequences(
    events: DataFrame | SplitEvents,
    part_events: int = PART_EVENTS,
    hot_events: int = HOT_EVENTS,
) -> DataFrame:
    """Ordered sequences ``(site, user, part, states)``.

    Part ``i`` holds the states from position ``i * part_events`` on, ``part_events`` of them in
    all parts but the last. So no row outgrows memory, nothing is cut off, and neither settings
    nor the path of a sequence change a row.
    """
    split = split_events(events, hot_events)
    columns = [*SEQUENCE, "part", "states"]
    out = in_parts(ordered_steps(split.cold, KEYS), part_events).select(*columns)
    if split.hot is not None:
        out = out.unionByName(in_parts(sliced_steps(split.hot), part_events).select(*columns))
    return out
