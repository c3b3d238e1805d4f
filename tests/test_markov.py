import math
import random
from collections import Counter

import pytest
from conftest import events_frame
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strayline.operators.markov import (
    score_sequences, sequence_metrics, transition_counts, transition_matrix,
)
from strayline.operators.matrix import (
    column_sums, matrix_add, matrix_cell, matrix_from_string, matrix_increment, matrix_row,
    matrix_set, matrix_to_string, parse_states, row_stats, row_sums, state_domain,
)
from strayline.operators.sequences import build_sequences, split_events, state_pairs
from strayline.plans.detect import detect_outliers
from strayline.plans.markov import find_markov_outliers

GOLDEN = {"u1": "ABABC", "u2": "AAB", "u3": "CA", "u4": "B", "u5": "BBAC"}
STATES = ["A", "B", "C"]
# metric per user at scale 1 and 100
METRICS = {
    ("missprob", 1): {"u1": 0.5125, "u2": 0.6, "u3": 0.5, "u4": None, "u5": 0.683333},
    ("missprob", 100): {"u1": 51.25, "u2": 60.0, "u3": 50.0, "u4": None, "u5": 68.333333},
    ("missrate", 1): {"u1": 0.25, "u2": 0.5, "u3": 0.0, "u4": None, "u5": 0.666667},
    ("missrate", 100): {"u1": 0.25, "u2": 0.5, "u3": 0.0, "u4": None, "u5": 0.666667},
    ("entreduc", 1): {"u1": 0.671823, "u2": 0.669366, "u3": 0.666667, "u4": None, "u5": 0.664973},
    ("entreduc", 100): {"u1": 0.468589, "u2": 0.581965, "u3": 0.451398, "u4": None, "u5": 0.688491},
}


def cells(matrix, value="p"):
    return {(r["src"], r["dst"]): r[value] for r in matrix.collect()}


def metric_by_user(df):
    return {r["user"]: None if r["metric"] is None else round(r["metric"], 6) for r in df.collect()}


def reference_matrix(sequences, states, scale):
    """Brute force over plain lists."""
    counts = Counter((a, b) for s in sequences.values() for a, b in zip(s, s[1:]))
    out = {}
    for a in states:
        row = [counts[a, b] for b in states]
        row = [x + 1 for x in row] if min(row) == 0 else row
        out.update({(a, b): x * scale / sum(row) for b, x in zip(states, row)})
    return out


def reference_metric(sequence, m, states, metric):
    pairs = list(zip(sequence, sequence[1:]))
    if not pairs:
        return None
    def h(p):
        return -p * math.log(p)

    if metric == "missprob":
        return sum(m[a, k] for a, b in pairs for k in states if k != b) / len(pairs)
    if metric == "missrate":
        return sum(b != max(states, key=lambda k: m[a, k]) for a, b in pairs) / len(pairs)
    whole = sum(h(m[a, k]) for a, _ in pairs for k in states)
    return sum(h(m[a, k]) for a, b in pairs for k in states if k != b) / whole


def test_golden_matrix(spark):
    matrix = transition_matrix(events_frame(spark, GOLDEN), STATES, 1).cache()
    assert cells(matrix) == {
        ("A", "A"): 0.2, ("A", "B"): 0.6, ("A", "C"): 0.2,
        ("B", "A"): 0.5, ("B", "B"): 0.25, ("B", "C"): 0.25,
        ("C", "A"): 0.5, ("C", "B"): 0.25, ("C", "C"): 0.25,
    }
    assert cells(matrix, "support")["C", "B"] == 0 and cells(matrix, "support")["A", "B"] == 3
    assert [r["idx"] for r in state_domain(spark, "A,B,C").orderBy("state").collect()] == [0, 1, 2]
    matrix.unpersist()


@pytest.mark.parametrize("metric, scale", METRICS)
def test_golden_metrics(spark, metric, scale):
    events = events_frame(spark, GOLDEN)
    matrix = transition_matrix(events, "A,B,C", scale)
    assert metric_by_user(sequence_metrics(events, matrix, "A,B,C", metric)) == METRICS[metric, scale]
    scored = score_sequences(events, matrix, STATES, metric, 0.5)
    assert metric_by_user(scored) == METRICS[metric, scale]


def test_golden_flags(spark):
    rows = find_markov_outliers(events_frame(spark, GOLDEN), STATES, strategy="missprob", threshold=60).collect()
    assert {r["user"]: r["flag"] for r in rows} == {"u1": "no", "u2": "no", "u3": "no", "u4": "no", "u5": "yes"}
    assert {r["user"]: "".join(r["states"]) for r in rows} == GOLDEN


def test_zero_cell_correction_takes_all_cells_of_the_row(spark):
    m = cells(transition_matrix(events_frame(spark, GOLDEN), [*STATES, "D"], 1))
    assert m["A", "B"] == 4 / 9 and m["A", "D"] == 1 / 9 and m["D", "A"] == 0.25


def test_matrix_of_no_events_is_uniform(spark):
    empty = events_frame(spark, {"u": "A"}).limit(0)
    assert set(cells(transition_matrix(empty, STATES, 3)).values()) == {1.0}
    assert find_markov_outliers(empty, STATES, strategy="missrate", threshold=0.1).collect() == []


def test_undeclared_state_in_training_is_an_error(spark):
    for bad in ("AXB", "AX", "XA"):
        with pytest.raises(Exception, match="state not declared: X"):
            transition_matrix(events_frame(spark, {"u": bad}), STATES).collect()
    with pytest.raises(Exception, match="state not declared: NULL"):
        transition_matrix(events_frame(spark, {"u": ["A", None]}), STATES).collect()


def test_undeclared_state_alone_is_no_step(spark):
    rows = find_markov_outliers(events_frame(spark, {"u": "X", "v": "AB"}), STATES, strategy="missrate", threshold=0).collect()
    assert {r["user"]: r["metric"] for r in rows} == {"u": None, "v": 0.0}


def test_undeclared_state_in_scoring(spark):
    matrix = transition_matrix(events_frame(spark, GOLDEN), STATES, 1)
    target = events_frame(spark, {"u": "AX"})
    got = {m: sequence_metrics(target, matrix, STATES, m).first()["metric"] for m in ("missprob", "missrate", "entreduc")}
    assert got == {"missprob": pytest.approx(1.0), "missrate": 1.0, "entreduc": 1.0}
    for metric in got:
        with pytest.raises(Exception, match="state not declared: X"):
            sequence_metrics(events_frame(spark, {"u": "AXA"}), matrix, STATES, metric).collect()


def test_most_likely_target_ties_go_to_the_first_state(spark):
    events = events_frame(spark, {"u": "AB", "v": "AC", "w": "AA"})
    matrix = transition_matrix(events, ["C", "B", "A"], 1)
    got = metric_by_user(sequence_metrics(events, matrix, ["C", "B", "A"], "missrate"))
    assert got == {"u": 1.0, "v": 0.0, "w": 1.0}


def test_order_of_equal_timestamps(spark):
    rows = [("s", "u", 1, 3, "C"), ("s", "u", 1, 1, "B"), ("s", "u", 1, 2, "A"), ("s", "u", 0, 9, "C")]
    events = spark.createDataFrame(rows, "site string, user string, timestamp long, tiebreak long, state string")
    assert build_sequences(events).first()["states"] == ["C", "B", "A", "C"]
    assert build_sequences(events.drop("tiebreak")).first()["states"] == ["C", "A", "B", "C"]


def test_same_user_on_two_sites_is_two_sequences(spark):
    events = events_frame(spark, {"u": "AB"}, "x").union(events_frame(spark, {"u": "CA"}, "y"))
    assert cells(transition_counts(events), "support") == {("A", "B"): 1, ("C", "A"): 1}


def test_long_sequences_come_in_parts(spark):
    word = "ABCAB" * 5
    rows = build_sequences(events_frame(spark, {"u": word, "v": "C"}), part_events=4).orderBy("user", "part").collect()
    assert [r["part"] for r in rows] == [0, 1, 2, 3, 4, 5, 6, 0]
    assert "".join("".join(r["states"]) for r in rows if r["user"] == "u") == word
    events = events_frame(spark, {"u": word})
    matrix = transition_matrix(events, STATES)
    whole = score_sequences(events, matrix, STATES, "entreduc", 0.1).collect()
    parts = score_sequences(events, matrix, STATES, "entreduc", 0.1, part_events=4).collect()
    assert len(whole) == 1 and len(parts) == 7
    by_part = {r["part"]: r for r in parts}
    assert round(by_part[0]["metric"], 12) == round(whole[0]["metric"], 12)
    assert by_part[0]["flag"] == whole[0]["flag"]
    assert all(by_part[i]["metric"] is None and by_part[i]["flag"] is None for i in range(1, 7))


# --- hot sequences ----------------------------------------------------------------------------


def skewed(seed=1, n=400):
    """One sequence with most of all events, a second long one, and short ones."""
    rng = random.Random(seed)
    sequences = {f"u{i}": "".join(rng.choices("ABC", k=rng.randrange(1, 6))) for i in range(20)}
    sequences["hot"] = "".join(rng.choices("ABC", [6, 3, 1], k=n))
    sequences["warm"] = "".join(rng.choices("ABC", k=n // 2))
    return sequences


def test_no_hot_sequence_means_no_split(spark):
    events = events_frame(spark, GOLDEN)
    assert split_events(events) == (events, None)


def test_hot_sequences_are_sliced_evenly(spark):
    cold, hot = split_events(events_frame(spark, skewed()), hot_events=50)
    assert {r["user"] for r in hot.select("user").distinct().collect()} == {"hot", "warm"}
    assert cold.where("user in ('hot', 'warm')").count() == 0
    sizes = {(r["user"], r["slice"]): r["count"] for r in hot.groupBy("user", "slice").count().collect()}
    assert sum(sizes.values()) == 600 and len({s for _, s in sizes}) > 4
    assert max(sizes.values()) < 200


def test_hot_path_equals_plain_path(spark):
    sequences = skewed()
    events = events_frame(spark, sequences)
    split = split_events(events, hot_events=50)
    assert split.hot is not None
    assert cells(transition_counts(split), "support") == dict(
        Counter((a, b) for s in sequences.values() for a, b in zip(s, s[1:]))
    )
    assert state_pairs(split).count() == sum(len(s) - 1 for s in sequences.values())
    expected = reference_matrix(sequences, STATES, 100)
    matrix = transition_matrix(split, STATES)
    assert cells(matrix) == pytest.approx(expected)

    rows = build_sequences(split, part_events=30).orderBy("user", "part").collect()
    text = {u: "".join("".join(r["states"]) for r in rows if r["user"] == u) for u in sequences}
    assert text == sequences and max(len(r["states"]) for r in rows) <= 30
    for metric in ("missprob", "missrate", "entreduc"):
        want = {u: reference_metric(s, expected, STATES, metric) for u, s in sequences.items()}
        scored = score_sequences(split, matrix, STATES, metric, 0.5, part_events=30).collect()
        assert len(scored) == len(rows)
        assert all((r["flag"] is None) == (r["part"] > 0) for r in scored)
        assert all(r["metric"] is None for r in scored if r["part"] > 0)
        got = {r["user"]: r["metric"] for r in scored if r["part"] == 0}
        alone = {r["user"]: r["metric"] for r in sequence_metrics(split, matrix, STATES, metric).collect()}
        assert set(got) == set(alone) == set(want)
        for u in want:
            assert got[u] == (None if want[u] is None else pytest.approx(want[u]))
            assert alone[u] == (None if want[u] is None else pytest.approx(want[u]))


@pytest.mark.parametrize("partitions", [4, 16])
def test_rows_do_not_depend_on_path_or_partitions(spark, partitions):
    sequences = skewed()
    matrix = transition_matrix(events_frame(spark, sequences), STATES)

    def rows(hot_events):
        split = split_events(events_frame(spark, sequences), hot_events)
        scored = score_sequences(split, matrix, STATES, "missrate", 0.5, part_events=70)
        return sorted(
            ((r["user"], r["part"], r["states"], r["flag"], r["metric"] and round(r["metric"], 9)) for r in scored.collect()),
            key=lambda r: r[:2],
        )

    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        plain, hot = rows(10_000), rows(50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert plain == hot
    for user, states in sequences.items():
        of_user = [r for r in plain if r[0] == user]
        assert [r[1] for r in of_user] == list(range(len(of_user)))
        assert all(len(r[2]) == 70 for r in of_user[:-1])
        assert "".join("".join(r[2]) for r in of_user) == states


def test_equal_hot_events_are_cut_too(spark):
    rows = [("s", "u", 5, "A")] * 60 + [("s", "u", 6, "B")]
    events = spark.createDataFrame(rows, "site string, user string, timestamp long, state string")
    split = split_events(events, hot_events=10)
    assert max(r["count"] for r in split.hot.groupBy("slice").count().collect()) < 30
    assert cells(transition_counts(split), "support") == {("A", "A"): 59, ("A", "B"): 1}


def test_hot_sequence_without_user_name_and_with_equal_timestamps(spark):
    rng = random.Random(4)
    rows = [("s", None, t // 3, t, rng.choice("AB")) for t in range(300)] + [("s", "u", 1, 1, "A"), ("s", "u", 2, 2, "B")]
    events = spark.createDataFrame(rows, "site string, user string, timestamp long, tiebreak long, state string").repartition(4)
    split = split_events(events, hot_events=20)
    assert split.hot.count() == 300 and split.cold.count() == 2
    word = "".join(r[4] for r in rows[:300])
    got = cells(transition_counts(split), "support")
    want = Counter(zip(word, word[1:])) + Counter([("A", "B")])
    assert got == dict(want)
    scored = score_sequences(split, transition_matrix(split, "A,B"), "A,B", "missrate", 0.5).collect()
    assert sum(len(r["states"]) for r in scored) == 302


def test_hot_events_with_a_timestamp_column(spark):
    word = "".join(random.Random(9).choices("ABC", k=90))
    events = events_frame(spark, {"u": word, "v": "AB"})
    for kind in ("timestamp", "timestamp_ntz"):
        typed = events.withColumn("timestamp", F.timestamp_seconds("timestamp").cast(kind))
        split = split_events(typed, hot_events=10)
        assert split.hot.select("slice").distinct().count() > 2
        text = build_sequences(split).where("user = 'u'").orderBy("part").collect()
        assert "".join("".join(r["states"]) for r in text) == word


def test_events_without_time_come_first(spark):
    rows = [("s", "u", t if t > 5 else None, t, "AB"[t % 2]) for t in range(60)]
    events = spark.createDataFrame(rows, "site string, user string, timestamp long, tiebreak long, state string")
    split = split_events(events, hot_events=10)
    assert split.hot is not None
    assert cells(transition_counts(split), "support") == {("A", "B"): 30, ("B", "A"): 29}


def test_all_hot_events_at_one_time(spark):
    rows = [("s", "u", 5, t, "AB"[t % 2]) for t in range(60)]
    events = spark.createDataFrame(rows, "site string, user string, timestamp long, tiebreak long, state string")
    split = split_events(events, hot_events=10)
    assert cells(transition_counts(split), "support") == {("A", "B"): 30, ("B", "A"): 29}


# --- plans ------------------------------------------------------------------------------------


def test_events_are_shuffled_once(spark, tmp_path):
    """Training and scoring share one exchange of the events."""
    events_frame(spark, skewed()).write.parquet(f"{tmp_path}/e")
    found = find_markov_outliers(spark.read.parquet(f"{tmp_path}/e"), STATES, strategy="missprob", threshold=1)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final and "SortMergeJoin" not in final
    of_events = [line for line in final.splitlines() if "hashpartitioning(user" in line]
    assert sum("ReusedExchange" not in line for line in of_events) == 1


# --- matrices ---------------------------------------------------------------------------------


def test_matrix_text(spark):
    matrix = transition_matrix(events_frame(spark, GOLDEN), STATES)
    text = matrix_to_string(matrix)
    assert text.first()["matrix"] == "20.0,60.0,20.0;50.0,25.0,25.0;50.0,25.0,25.0"
    assert cells(matrix_from_string(text, STATES)) == cells(matrix)


def test_matrix_sums_and_rows(spark):
    matrix = transition_matrix(events_frame(spark, GOLDEN), STATES)
    assert {r["src"]: r["row_sum"] for r in row_sums(matrix).collect()} == {"A": 100, "B": 100, "C": 100}
    assert {r["dst"]: r["col_sum"] for r in column_sums(matrix).collect()} == {"A": 120, "B": 110, "C": 70}
    stats = {r["src"]: r for r in row_stats(matrix).collect()}
    assert (stats["A"]["best"], stats["A"]["row_min"], stats["A"]["row_max"]) == ("B", 20.0, 60.0)
    assert [r["dst"] for r in matrix_row(matrix, "A").collect()] == STATES
    assert matrix_cell(matrix, "A", "B").first()["p"] == 60.0


def test_matrix_changes(spark):
    matrix = transition_matrix(events_frame(spark, GOLDEN), STATES)
    deltas = spark.createDataFrame([("A", "B", 2.0), ("A", "B", 1.0), ("C", "C", -5.0)], "src string, dst string, p double")
    added = cells(matrix_add(matrix, deltas))
    assert added["A", "B"] == 63.0 and added["C", "C"] == 20.0 and added["A", "A"] == 20.0
    assert cells(matrix_increment(matrix, deltas))["A", "B"] == 62.0
    assert cells(matrix_set(matrix, deltas.limit(1)))["A", "B"] == 2.0
    with pytest.raises(Exception, match="no such cell: A X"):
        matrix_add(matrix, spark.createDataFrame([("A", "X", 1.0)], "src string, dst string, p double")).collect()


def test_many_states_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("strayline.operators.markov.BROADCAST_CELLS", 1)
    events = events_frame(spark, GOLDEN)
    got = sequence_metrics(events, transition_matrix(events, STATES, 1), STATES, "missprob")
    assert metric_by_user(got) == METRICS["missprob", 1]


def test_steps_of_many_states_are_dealt_by_salt(spark):
    states = [f"s{i}" for i in range(2000)]
    events = events_frame(spark, {"u": ["s1", "s2", "s1"]})
    matrix = spark.createDataFrame(
        [("s1", "s2", 0, 1, 0.5), ("s2", "s1", 1, 0, 1.0)], "src string, dst string, src_idx int, dst_idx int, p double"
    )
    got = sequence_metrics(events, matrix, states, "missrate")
    assert [r["metric"] for r in got.collect()] == [0.0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = sequence_metrics(events, matrix, states, "missrate")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_pair = [line for line in plan.splitlines() if "hashpartitioning(_prev" in line or "hashpartitioning(_src" in line]
    assert by_pair and all("salt" in line for line in by_pair)


def test_matrix_without_a_cell_or_with_a_cell_twice(spark):
    schema = "src string, dst string, src_idx int, dst_idx int, p double"
    events = events_frame(spark, {"u": "AB"})
    lacking = spark.createDataFrame([("A", "A", 0, 0, 1.0)], schema)
    with pytest.raises(Exception, match="no matrix cell for step: A > B"):
        sequence_metrics(events, lacking, "A,B", "missrate").collect()
    double = spark.createDataFrame([("A", "B", 0, 1, 1.0), ("A", "B", 0, 1, 2.0)], schema)
    with pytest.raises(Exception, match="matrix cell given twice in row A"):
        sequence_metrics(events, double, "A,B", "missprob").collect()


def test_parse_states():
    assert parse_states("b,a") == ["b", "a"]
    for bad in ("a,a", []):
        with pytest.raises(ValueError):
            parse_states(bad)


def test_unknown_metric(spark):
    with pytest.raises(ValueError, match="strategy"):
        detect_outliers(events_frame(spark, GOLDEN), "MARKOV", scale=1, states="A,B,C", strategy="x", threshold=1)


# --- properties -------------------------------------------------------------------------------


@settings(max_examples=5, deadline=None)
@given(
    st.dictionaries(st.sampled_from("uvwxyz"), st.text("ABCD", min_size=1, max_size=12), min_size=1),
    st.sampled_from([1, 10, 100]),
    st.integers(1, 6),
)
def test_random_sequences(spark, sequences, scale, partitions):
    states = list("ABCD")
    events = events_frame(spark, sequences).repartition(partitions)
    expected = reference_matrix(sequences, states, scale)
    matrix = transition_matrix(events, states, scale)
    assert cells(matrix) == pytest.approx(expected)
    sums = matrix.groupBy("src").agg(F.sum("p").alias("s"), F.min("p").alias("least")).collect()
    assert all(math.isclose(r["s"], scale) and r["least"] > 0 for r in sums)
    for metric in ("missprob", "missrate", "entreduc"):
        if metric == "entreduc" and scale != 1:
            continue
        got = {r["user"]: r["metric"] for r in sequence_metrics(events, matrix, states, metric).collect()}
        for user, s in sequences.items():
            want = reference_metric(s, expected, states, metric)
            assert got[user] == (None if want is None else pytest.approx(want))
