"""Matrices of seen cells and a default per row, and support that is kept and added to."""

import math
import random

import pytest
from conftest import events_frame
from pyspark.sql import functions as F

from strayline.operators import sparse
from strayline.operators.markov import score_sequences, sequence_metrics, sparse_transitions, transition_matrix
from strayline.operators.matrix import column_sums, matrix_row, row_stats
from strayline.operators.matrix_lines import read_matrix_lines, write_matrix_lines
from strayline.operators.sparse import dense, sparse_column_sums, sparse_row, sparse_row_stats
from strayline.operators.support import add_support, read_support, store_support, stored_matrix, train_support
from strayline.plans.markov import find_markov_outliers

STATES = ["A", "B", "C", "D"]
SEQUENCES = {"u1": "ABABC", "u2": "AAB", "u3": "CA", "u4": "B", "u5": "BBAC", "u6": "AC"}


def near(rows, key, *numbers):
    return {tuple(r[k] for k in key): tuple(pytest.approx(r[n]) for n in numbers) for r in rows}


@pytest.mark.parametrize("states, scale", [(STATES, 1), (["C", "B", "A"], 100)])
def test_sparse_equals_dense(spark, states, scale):
    events = events_frame(spark, SEQUENCES)
    whole, few = transition_matrix(events, states, scale).cache(), sparse_transitions(events, states, scale)
    cell = ("src", "dst", "src_idx", "dst_idx", "support")
    assert {tuple(r[k] for k in cell): (r["p"],) for r in whole.collect()} == near(dense(few).collect(), cell, "p")
    numbers = ("row_sum", "row_min", "row_max", "row_entropy")
    expected = {(r["src"], r["best"]): tuple(r[n] for n in numbers) for r in row_stats(whole).collect()}
    assert expected == near(sparse_row_stats(few).collect(), ("src", "best"), *numbers)
    sums = {(r["dst"],): (r["col_sum"],) for r in column_sums(whole).collect()}
    assert sums == near(sparse_column_sums(few).collect(), ("dst",), "col_sum")
    assert [r["dst"] for r in sparse_row(few, "A").collect()] == [r["dst"] for r in matrix_row(whole, "A").collect()]
    assert sparse_row(few, "X").collect() == []
    other = events_frame(spark, {"v": ["A", "D" if "D" in states else "X", "C"][: 2 if "D" not in states else 3], "w": "CCCB", "x": "A"})
    for metric in ("missprob", "missrate", "entreduc"):
        for scored, only_seen in ((events, True), (events, False), (other, False)):
            want = {r["user"]: r["metric"] for r in sequence_metrics(scored, whole, states, metric).collect()}
            got = {r["user"]: r["metric"] for r in sequence_metrics(scored, few, None, metric, only_seen).collect()}
            assert got == {u: None if m is None else pytest.approx(m) for u, m in want.items()}


def test_without_broadcast(spark, monkeypatch):
    events = events_frame(spark, SEQUENCES)
    few = sparse_transitions(events, STATES, 1)
    want = {r["user"]: r["metric"] for r in sequence_metrics(events, few, None, "entreduc").collect()}
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", 0)
    few = sparse_transitions(events, STATES, 1)
    assert want == {r["user"]: r["metric"] for r in sequence_metrics(events, few, None, "entreduc").collect()}


def test_no_table_beyond_the_bound_is_broadcast(spark, monkeypatch):
    """However few bytes the table is estimated at, and the matrix is looked up without copies of it."""
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", 0)
    events = events_frame(spark, SEQUENCES)
    for metric in ("missrate", "entreduc"):
        scored = sequence_metrics(events, sparse_transitions(events, STATES, 1), None, metric, only_seen=True)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan and "salt" not in plan
    frequent = events_frame(spark, {"u": "AB" * 2_000, "v": "A", "w": "ABC"})
    scored = sequence_metrics(frequent, sparse_transitions(events, STATES, 1), None, "missprob")
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", 100)
    told = sequence_metrics(frequent, sparse_transitions(events, STATES, 1), None, "missprob")
    want = {r["user"]: r["metric"] for r in told.collect()}
    assert {r["user"]: r["metric"] for r in scored.collect()} == {u: None if m is None else pytest.approx(m) for u, m in want.items()}


def test_a_hundred_thousand_states(spark):
    """No part of it has a row per pair of states, which are ten thousand million."""
    n = 100_000
    states = spark.range(n).select(F.concat(F.lit("s"), F.col("id")).alias("state"), F.col("id").alias("idx"))
    rng = random.Random(1)
    sequences = {f"u{i}": [f"s{rng.choice([7, rng.randrange(n)])}" for _ in range(20)] for i in range(40)}
    events = events_frame(spark, sequences)
    few = sparse_transitions(events, states, 1)
    support, rows = {}, {}
    for s in sequences.values():
        for a, b in zip(s, s[1:]):
            support[a, b] = support.get((a, b), 0) + 1
            rows[a] = rows.get(a, 0) + 1

    def miss_prob(s):
        steps = [1 - (support.get((a, b), 0) + 1) / (rows.get(a, 0) + n) for a, b in zip(s, s[1:])]
        return sum(steps) / len(steps)

    got = {r["user"]: r["metric"] for r in sequence_metrics(events, few, None, "missprob").collect()}
    assert got == {u: pytest.approx(miss_prob(s), abs=1e-9) for u, s in sequences.items()}
    other = {"v": ["s1", "s2", "s3"], "w": ["s7", "s7"], "x": ["s5", "not declared"]}
    got = {r["user"]: r["metric"] for r in sequence_metrics(events_frame(spark, other), few, None, "missprob").collect()}
    assert got == {"v": pytest.approx(miss_prob(other["v"])), "w": pytest.approx(miss_prob(other["w"])), "x": 1.0}
    stats = sparse_row_stats(few).agg(F.count("*").alias("n"), F.min("row_sum").alias("low"), F.max("row_sum").alias("high")).first()
    assert stats["n"] == n and math.isclose(stats["low"], 1) and math.isclose(stats["high"], 1)
    found = find_markov_outliers(events, states, strategy="missrate", threshold=0.5)
    assert found.count() == 40


def test_states_that_cannot_be(spark):
    events = events_frame(spark, SEQUENCES)
    for rows in ([("A", 0), ("A", 1)], [("A", 0), ("B", 0)], [("A", 1), ("B", 2)], []):
        with pytest.raises(ValueError, match="states"):
            sparse_transitions(events, spark.createDataFrame(rows, "state string, idx int"))
    with pytest.raises(Exception, match="state not declared: C"):
        dense(sparse_transitions(events, "A,B")).collect()
    few = sparse_transitions(events, STATES)
    with pytest.raises(Exception, match="state not declared: X > A"):
        sequence_metrics(events_frame(spark, {"u": "XA"}), few, None, "missrate").collect()


def test_no_events(spark):
    few = sparse_transitions(events_frame(spark, {"u": "A"}).limit(0), STATES, 2)
    assert {r["p"] for r in dense(few).collect()} == {0.5}
    assert score_sequences(events_frame(spark, {"u": "AD"}), few, None, "missrate", 0.5).first()["metric"] == 1.0
    assert score_sequences(events_frame(spark, {"u": "DA"}), few, None, "missrate", 0.5).first()["metric"] == 0.0


# --- lines of text ----------------------------------------------------------------------------


def test_matrix_lines(spark, tmp_path):
    n = 600
    idx = spark.range(n * n).select((F.col("id") / n).cast("int").alias("src_idx"), (F.col("id") % n).cast("int").alias("dst_idx"))
    matrix = idx.withColumn("p", F.col("src_idx") + F.col("dst_idx") / 1000).repartition(5)
    states = [f"s{i}" for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # several stretches of a file
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_matrix_lines(matrix, f"{tmp_path}/m")
        assert len(list(tmp_path.glob("m/part-*"))) > 1
        read = read_matrix_lines(spark, f"{tmp_path}/m", states)
        wrong = read.where((F.col("p") != F.col("src_idx") + F.col("dst_idx") / 1000) | (F.col("src") != F.concat(F.lit("s"), "src_idx")) | (F.col("dst") != F.concat(F.lit("s"), "dst_idx")))
        assert (read.count(), wrong.count(), read.select("src_idx", "dst_idx").distinct().count()) == (n * n, 0, n * n)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for bad in (states[:-1], [*states, "x"]):
        with pytest.raises(Exception, match="does not have"):
            read_matrix_lines(spark, f"{tmp_path}/m", bad).collect()


# --- support ----------------------------------------------------------------------------------


def in_order(rows):
    return sorted(map(tuple, rows))


def cut_events(spark, events, at):
    return events.where(F.col("timestamp") < at), events.where(F.col("timestamp") >= at)


@pytest.mark.parametrize("at", [0, 2, 9])
def test_added_support_is_that_of_all(spark, at):
    events = events_frame(spark, SEQUENCES).unionByName(events_frame(spark, {"u1": "CC", None: "AB"}, site=None))
    first, later = cut_events(spark, events, at)
    whole, both = train_support(events), add_support(train_support(first), later)
    assert in_order(both.counts.collect()) == in_order(whole.counts.collect())
    tails = ["user", "site", "timestamp", "state"]
    assert sorted(map(str, both.tails.select(tails).collect())) == sorted(map(str, whole.tails.select(tails).collect()))


def test_stored_support(spark, tmp_path):
    events = events_frame(spark, SEQUENCES)
    first, later = cut_events(spark, events, 2)
    store = str(tmp_path)
    with pytest.raises(LookupError):
        read_support(spark, store, "u")
    assert store_support(first, store, "u", "1") and store_support(later, store, "u", "2")
    assert not store_support(later, store, "u", "2")
    assert in_order(read_support(spark, store, "u").counts.collect()) == in_order(train_support(events).counts.collect())
    kept = {r["user"]: r["metric"] for r in sequence_metrics(events, stored_matrix(spark, store, "u", STATES, 1), None, "missprob").collect()}
    new = {r["user"]: r["metric"] for r in sequence_metrics(events, transition_matrix(events, STATES, 1), STATES, "missprob").collect()}
    assert kept == {u: None if m is None else pytest.approx(m) for u, m in new.items()}
    with pytest.raises(Exception, match="before the last one"):
        store_support(first, store, "u", "3")
    assert in_order(read_support(spark, store, "u").counts.collect()) == in_order(train_support(events).counts.collect())
