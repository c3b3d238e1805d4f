"""Support of transitions that is kept and added to, so that new events need no second look at old ones.

What a run of events leaves behind is its counts and the last event of every sequence. Later events
add their own counts and, per sequence, the step from that last event to their first.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strayline.operators.markov import transition_counts
from strayline.operators.sequences import KEYS, order_names, same_keys
from strayline.operators.sparse import SparseMatrix, sparse_matrix
from strayline.sources.files import exists
from strayline.sources.store import append_records, check_uid, create_store, read_records, table_path


class Support(NamedTuple):
    """``counts``: ``(src, dst, support)``, and ``tails``: one event ``(site, user, timestamp
    [, tiebreak], state)`` per sequence, its last."""

    counts: DataFrame
    tails: DataFrame


def _ends(events: DataFrame, end, alias: str) -> DataFrame:
    at = F.struct(*order_names(events))
    return events.groupBy(*KEYS).agg(end(at).alias(alias))


def train_support(events: DataFrame) -> Support:
    """The support of events that begin all of their sequences."""
    tails = _ends(events, F.max, "_last").select(*KEYS, "_last.*")
    return Support(transition_counts(events), tails)


def later_support(tails: DataFrame, events: DataFrame) -> Support:
    """What ``events`` add to a support that ends with ``tails``: their counts with the steps across
    the seam, and the new last events of their sequences.

    An event that comes before the last one of its sequence is an error.
    """
    names = order_names(events)
    last = tails.select(*[F.col(c).alias(f"_old_{c}") for c in KEYS], F.struct(*names).alias("_last"))
    heads = _ends(events, F.min, "_first")
    met = heads.join(last, same_keys("", "_old_", KEYS))
    late: Column = F.raise_error(F.concat_ws(" ", F.lit("an event before the last one of sequence"), *KEYS))
    src = F.when(F.col("_first") < F.col("_last"), late.cast("string")).otherwise(F.col("_last.state"))
    seams = met.select(src.alias("src"), F.col("_first.state").alias("dst")).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("support")
    )
    own = train_support(events)
    return Support(_added(own.counts.unionByName(seams)), own.tails)


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("src", "dst").agg(F.sum("support").alias("support"))


def add_support(old: Support, events: DataFrame) -> Support:
    """The support of the old events and these later ones together."""
    new = later_support(old.tails, events)
    tails = _ends(old.tails.unionByName(new.tails), F.max, "_last").select(*KEYS, "_last.*")
    return Support(_added(old.counts.unionByName(new.counts)), tails)


# --- kept with a run --------------------------------------------------------------------------


def _split(records: DataFrame) -> Support:
    events = [f.name for f in records.schema.fields if f.name not in ("src", "dst", "support")]
    counts = _added(records.where("support is not null").select("src", "dst", "support"))
    tails = _ends(records.where("support is null").select(*events), F.max, "_last")
    return Support(counts, tails.select(*KEYS, "_last.*"))


def store_support(events: DataFrame, store: str, uid: str, batch: str) -> bool:
    """Keep the support of a batch of events with a run, or add it to what the run has.

    Batches come in the order of time: no event may precede the last one of its sequence. A batch
    that is there already adds nothing, and False is returned. Counts and last events of a batch
    are one commit; what is read of earlier batches is their counts and tails, not their events.
    """
    spark = events.sparkSession
    path = table_path(store, "support", check_uid(uid))
    if exists(spark, f"{path}/commits/{check_uid(batch)}"):
        return False
    events = events.select(*KEYS, *order_names(events))
    if not exists(spark, f"{path}/schema"):
        of_event = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
        create_store(spark, path, f"{of_event}, src string, dst string, support long")
    new = later_support(_split(read_records(spark, path)).tails, events)
    rows = new.tails.unionByName(new.counts, allowMissingColumns=True)
    return append_records(rows, path, batch)


def read_support(spark: SparkSession, store: str, uid: str) -> Support:
    """What `store_support` has kept of a run; LookupError if it has nothing."""
    path = table_path(store, "support", check_uid(uid))
    if not exists(spark, f"{path}/schema"):
        raise LookupError(f"support of uid '{uid}' does not exist")
    return _split(read_records(spark, path))


def stored_matrix(spark: SparkSession, store: str, uid: str, states, scale: float = 100) -> SparseMatrix:
    """The transition matrix of all batches that a run has, ready to score any events by."""
    return sparse_matrix(read_support(spark, store, uid).counts, states, scale)
