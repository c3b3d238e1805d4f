"""Queries on state events: sequences, transition matrices, metrics and flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strayline.operators.markov import (
    entropy_reduction,
    miss_prob,
    miss_rate,
    score_sequences,
    sequence_metrics,
    sparse_transitions,
    transition_counts,
    transition_matrix,
)
from strayline.operators.matrix import (
    column_sums,
    matrix_add,
    matrix_from_string,
    matrix_increment,
    matrix_row,
    matrix_set,
    matrix_to_string,
    row_stats,
    state_index,
)
from strayline.operators.sequences import build_sequences, split_events, state_pairs
from strayline.operators.sparse import dense, sparse_column_sums, sparse_row_stats
from strayline.plans.detect import detect_outliers
from strayline.plans.markov import find_markov_outliers
from strayline.sources.specs import Field, apply_field_spec
from strayline.suite.tables import (
    EVENT_SPEC,
    EVENT_STATES,
    EVENT_STATES_SQL,
    ORDER_SPEC,
    ORDER_STATES,
    ORDER_STATES_SQL,
    event_states,
    order_states,
    rounded,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]

# a state that never occurs: every row of the matrix then holds a zero
WITH_REFUND = [*EVENT_STATES, "refund"]


def q_mapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_field_spec(table(spark, sf_dir, "orders"), ORDER_SPEC)


def q_mapping_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("site", F.lit("all"))
    return apply_field_spec(events, EVENT_SPEC, tiebreak="event_id")


def q_state_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per declared state and its index."""
    counts = event_states(spark, sf_dir).groupBy("site", "state").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("site", "state", state_index(F.col("state"), EVENT_STATES).alias("idx"), "n")


def _sequences(load) -> Query:
    return lambda spark, sf_dir: build_sequences(load(spark, sf_dir)).select(
        "site", "user", "part", F.array_join("states", ",").alias("states")
    )


def _pairs(load) -> Query:
    return lambda spark, sf_dir: state_pairs(load(spark, sf_dir)).groupBy(
        "site", "user", "src", "dst"
    ).agg(F.count(F.lit(1)).alias("n"))


def _counts(load) -> Query:
    return lambda spark, sf_dir: transition_counts(load(spark, sf_dir))


def _matrix(load, states, scale=100) -> Query:
    return lambda spark, sf_dir: transition_matrix(load(spark, sf_dir), states, scale).withColumn(
        "p", rounded("p")
    )


def _event_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transition_matrix(event_states(spark, sf_dir), EVENT_STATES)


def q_row_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = transition_matrix(event_states(spark, sf_dir), EVENT_STATES, 1)
    numbers = ["row_sum", "row_min", "row_max", "row_entropy"]
    return row_stats(matrix).select("src", "best", *[rounded(c).alias(c) for c in numbers])


def q_column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_sums(_event_matrix(spark, sf_dir)).withColumn("col_sum", rounded("col_sum"))


def q_matrix_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the raw support to the scaled matrix, then 1 to each observed cell."""
    events = split_events(event_states(spark, sf_dir))
    counts = transition_counts(events)
    support = counts.select("src", "dst", F.col("support").cast("double").alias("p"))
    added = matrix_add(transition_matrix(events, EVENT_STATES), support)
    return matrix_increment(added, counts).withColumn("p", rounded("p"))


def q_matrix_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace every cell by its support, then read one row."""
    events = split_events(event_states(spark, sf_dir))
    counts = transition_counts(events)
    support = counts.select("src", "dst", F.col("support").cast("double").alias("p"))
    replaced = matrix_set(transition_matrix(events, EVENT_STATES), support)
    return matrix_row(replaced, "view").select("src", "dst", "src_idx", "dst_idx", "p")


def q_matrix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_to_string(_event_matrix(spark, sf_dir).withColumn("p", rounded("p", 3)))


def q_matrix_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = matrix_to_string(_event_matrix(spark, sf_dir))
    return matrix_from_string(text, EVENT_STATES).withColumn("p", rounded("p"))


def _metric(load, states, metric, scale=100) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = split_events(load(spark, sf_dir))
        scored = metric(events, transition_matrix(events, states, scale), states)
        return scored.withColumn("metric", rounded("metric"))

    return run


def _text(scored: DataFrame) -> DataFrame:
    return scored.select(
        "site", "user", "part", F.array_join("states", ",").alias("states"),
        rounded("metric").alias("metric"), "flag",
    )


def _flags(load, states, metric, threshold, scale=100) -> Query:
    return lambda spark, sf_dir: _text(
        find_markov_outliers(
            load(spark, sf_dir), states, scale=scale, strategy=metric, threshold=threshold
        )
    )


def q_detect_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(
        detect_outliers(
            event_states(spark, sf_dir), "MARKOV",
            states=",".join(EVENT_STATES), scale=1, strategy="missprob", threshold=0.8,
        )
    )


def q_score_by_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the orders of each customer by the matrix of the orders by priority."""
    orders = table(spark, sf_dir, "orders")
    by_priority = transition_matrix(
        apply_field_spec(orders, ORDER_SPEC, tiebreak="o_orderkey"), ORDER_STATES
    )
    return _text(
        score_sequences(order_states(spark, sf_dir), by_priority, ORDER_STATES, "entreduc", 0.6)
    )


def q_sparse_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of a sparse matrix in which every row has unseen ones."""
    return dense(sparse_transitions(event_states(spark, sf_dir), WITH_REFUND)).withColumn("p", rounded("p"))


def q_sparse_row_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ["row_sum", "row_min", "row_max", "row_entropy"]
    stats = sparse_row_stats(sparse_transitions(event_states(spark, sf_dir), WITH_REFUND, 1))
    return stats.select("src", "best", *[rounded(c).alias(c) for c in numbers])


def q_sparse_col_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = sparse_column_sums(sparse_transitions(event_states(spark, sf_dir), WITH_REFUND))
    return sums.withColumn("col_sum", rounded("col_sum"))


def q_sparse_score_by_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `q_score_by_other`, by a sparse matrix: steps without a cell take the default of their row."""
    orders = apply_field_spec(table(spark, sf_dir, "orders"), ORDER_SPEC, tiebreak="o_orderkey")
    by_priority = sparse_transitions(orders, ORDER_STATES)
    return _text(score_sequences(order_states(spark, sf_dir), by_priority, None, "entreduc", 0.6))


PART_SPEC = [
    Field("site", "string", "site"),
    Field("user", "string", "l_suppkey"),
    Field("timestamp", "long", "l_orderkey"),
    Field("state", "string", "l_partkey"),
]


def _part_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The parts that each supplier delivers, in the order of orders, and all parts as states."""
    lines = table(spark, sf_dir, "lineitem").withColumn("site", F.lit("all"))
    parts = table(spark, sf_dir, "part")
    states = parts.select(F.col("p_partkey").cast("string").alias("state"), F.col("p_partkey").cast("int").alias("idx"))
    return apply_field_spec(lines, PART_SPEC, tiebreak="l_linenumber"), states


def _part_metric(metric: str, only_seen: bool) -> Query:
    """A metric by a matrix over as many states as there are parts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events, states = _part_steps(spark, sf_dir)
        split = split_events(events)
        scored = sequence_metrics(split, sparse_transitions(split, states, 1), None, metric, only_seen)
        return scored.withColumn("metric", rounded("metric"))

    return run


def q_parts_by_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even suppliers scored by what the odd ones do: most of their steps have no seen cell."""
    events, states = _part_steps(spark, sf_dir)
    is_even = F.col("user").cast("long") % 2 == 0
    matrix = sparse_transitions(events.where(~is_even), states, 1)
    return sequence_metrics(events.where(is_even), matrix, None, "missprob").withColumn("metric", F.round("metric", 9) + 0.0)


QUERIES: dict[str, Query] = {
    "sparse_dense": q_sparse_dense,
    "sparse_row_stats": q_sparse_row_stats,
    "sparse_col_sums": q_sparse_col_sums,
    "sparse_score_by_other": q_sparse_score_by_other,
    "sparse_missrate_parts": _part_metric("missrate", True),
    "sparse_entreduc_parts": _part_metric("entreduc", True),
    "sparse_missprob_other_parts": q_parts_by_others,
    "field_mapping_orders": q_mapping_orders,
    "field_mapping_events": q_mapping_events,
    "state_index": q_state_index,
    "state_sequences_events": _sequences(event_states),
    "state_sequences_orders": _sequences(order_states),
    "state_pairs_events": _pairs(event_states),
    "state_pairs_orders": _pairs(order_states),
    "transition_counts_events": _counts(event_states),
    "transition_counts_orders": _counts(order_states),
    "transition_matrix_events": _matrix(event_states, EVENT_STATES),
    "transition_matrix_orders": _matrix(order_states, ORDER_STATES, 1),
    "transition_matrix_laplace": _matrix(event_states, WITH_REFUND),
    "matrix_row_stats": q_row_stats,
    "matrix_col_sums": q_column_sums,
    "matrix_add": q_matrix_add,
    "matrix_set_row": q_matrix_set,
    "matrix_text": q_matrix_text,
    "matrix_text_roundtrip": q_matrix_roundtrip,
    "missprob_events": _metric(event_states, EVENT_STATES, miss_prob),
    "missrate_events": _metric(event_states, EVENT_STATES, miss_rate),
    "entreduc_events": _metric(event_states, EVENT_STATES, entropy_reduction),
    "missprob_orders": _metric(order_states, ORDER_STATES, miss_prob),
    "missrate_orders": _metric(order_states, ORDER_STATES, miss_rate),
    "entreduc_orders": _metric(order_states, ORDER_STATES, entropy_reduction, 1),
    "missprob_laplace": _metric(event_states, WITH_REFUND, miss_prob),
    "markov_flags_events": _flags(event_states, EVENT_STATES, "missrate", 0.8),
    "markov_flags_orders": _flags(order_states, ORDER_STATES, "missprob", 55.0),
    "markov_detect": q_detect_markov,
    "markov_score_by_other": q_score_by_other,
}


def matrix_sql(states: list[str], scale: float, extra: str = "") -> str:
    """Common tables up to the matrix ``m`` and its row statistics ``r``, over the events ``st``.

    ``extra`` is a suffix of the table names, for a second set in one query.
    """
    x = extra
    return f"""dom{x} as (select unnest({states}) as s, unnest({list(range(len(states)))}) as i),
pairs{x} as (select * from (select site, usr, state as src,
  lead(state) over (partition by site, usr order by t, tb) as dst from st{x}) where dst is not null),
cnt{x} as (select src, dst, count(*) as n from pairs{x} group by all),
grid{x} as (select a.s as src, b.s as dst, a.i as src_idx, b.i as dst_idx, coalesce(n, 0) as n
  from dom{x} a cross join dom{x} b left join cnt{x} c on c.src = a.s and c.dst = b.s),
lap{x} as (select *, n + case when min(n) over (partition by src) = 0 then 1 else 0 end as c
  from grid{x}),
m{x} as (select src, dst, src_idx, dst_idx, n as support,
  c * {float(scale)}::double / sum(c) over (partition by src) as p from lap{x}),
r{x} as (select src, sum(p) as rs, min(p) as lo, max(p) as hi, sum(-p * ln(p)) as g,
  arg_min(dst, struct_pack(a := -p, b := dst_idx)) as best from m{x} group by src)"""


_METRIC_SQL = {
    "missprob": "avg(rs - m.p)",
    "missrate": "avg(case when best = p.dst then 0.0::double else 1 end)",
    "entreduc": "sum(g + m.p * ln(m.p)) / sum(g)",
}


def scored_sql(metric: str, extra: str = "") -> str:
    """``sc``: metric per sequence of ``st`` by the matrix with the given suffix."""
    return f"""u as (select site, usr, string_agg(state, ',' order by t, tb) as states
  from st group by all),
w as (select * from (select site, usr, state as src,
  lead(state) over (partition by site, usr order by t, tb) as dst from st) where dst is not null),
v as (select p.site, p.usr, {_METRIC_SQL[metric]} as metric
  from w p join m{extra} m on m.src = p.src and m.dst = p.dst join r{extra} r on r.src = p.src
  group by all),
sc as (select u.site, u.usr, u.states, v.metric from u left join v using (site, usr))"""


def metric_oracle(st: str, states: list[str], metric: str, scale: float = 100) -> str:
    return f"""with {st}, {matrix_sql(states, scale)}, {scored_sql(metric)}
select site, usr as "user", round(metric, 6) + 0.0 as metric from sc"""


def flags_select(threshold: float) -> str:
    return f"""select site, usr as "user", 0::bigint as part, states,
  round(metric, 6) + 0.0 as metric, case when metric > {threshold} then 'yes' else 'no' end as flag
from sc"""


def flags_oracle(st: str, states: list[str], metric: str, threshold: float, scale: float = 100) -> str:
    return f"with {st}, {matrix_sql(states, scale)}, {scored_sql(metric)} {flags_select(threshold)}"


def _matrix_oracle(st: str, states: list[str], scale: float = 100) -> str:
    return f"""with {st}, {matrix_sql(states, scale)}
select src, dst, src_idx, dst_idx, support, round(p, 6) + 0.0 as p from m"""


def _sequences_oracle(st: str) -> str:
    return f"""with {st} select site, usr as "user", 0::bigint as part,
  string_agg(state, ',' order by t, tb) as states from st group by site, usr"""


def _pairs_oracle(st: str) -> str:
    return f"""with {st}, p as (select site, usr, state as src,
  lead(state) over (partition by site, usr order by t, tb) as dst from st)
select site, usr as "user", src, dst, count(*) as n from p where dst is not null group by all"""


def _counts_oracle(st: str) -> str:
    return f"""with {st}, p as (select state as src,
  lead(state) over (partition by site, usr order by t, tb) as dst from st)
select src, dst, count(*) as support from p where dst is not null group by all"""


def _parts_sql(metric: str, trained: str = "true", scored: str = "true", digits: int = 6) -> str:
    """Metrics over the parts as states, without their grid: seen cells and the rest of each row."""
    return f"""with st as (select 'all' as site, cast(l_suppkey as varchar) as usr, l_orderkey as t,
  l_linenumber as tb, cast(l_partkey as varchar) as state from lineitem),
w as (select * from (select site, usr, state as src,
  lead(state) over (partition by site, usr order by t, tb, state) as dst from st) where dst is not null),
k as (select count(*) as n from part),
c as (select src, dst, count(*) as c from w where {trained} group by all),
o as (select src, n, case when count(*) < n then 1 else 0 end as plus, sum(c) as s from c, k group by src, n),
m as (select src, dst, (c + plus)::double / (s + plus * n) as p from c join o using (src)),
h as (select src, count(*) as seen, sum(p) as s, sum(-p * ln(p)) as h,
  arg_min(dst, struct_pack(a := -p, b := dst::int)) as best from m group by src),
r as (select p_partkey::varchar as src, k.n - coalesce(seen, 0) as rest,
  case when h.src is null then 1.0::double / k.n when plus = 1 then 1.0::double / (o.s + k.n) else 0 end as d,
  coalesce(best, '0') as best, coalesce(h.s, 0) as s, coalesce(h.h, 0) as h
  from part cross join k left join h on h.src = p_partkey::varchar left join o on o.src = p_partkey::varchar),
x as (select usr, w.dst, coalesce(m.p, d) as p, best, r.s + rest * d as rs,
  r.h + case when rest > 0 then -rest * d * ln(d) else 0 end as g
  from w join r on r.src = w.src left join m on m.src = w.src and m.dst = w.dst where {scored}),
v as (select usr, {metric} as metric from x group by usr)
select 'all' as site, usr as "user", round(metric, {digits}) + 0.0 as metric
from (select distinct usr from st where {scored}) left join v using (usr)"""


_E, _O = EVENT_STATES_SQL, ORDER_STATES_SQL
_EVENT_M = f"with {_E}, {matrix_sql(EVENT_STATES, 100)}"
_ORDERS_BY_PRIORITY = _O.replace("st as", "st2 as").replace("'all'", "o_orderpriority")

ORACLE = {
    "field_mapping_orders": """select o_orderpriority as site, cast(o_custkey as varchar) as "user",
  epoch_us(o_orderdate) as timestamp, o_orderstatus as state from orders""",
    "field_mapping_events": """select 'all' as site, cast(user_id as varchar) as "user",
  epoch_us(ts) as timestamp, event_type as state, event_id as tiebreak from events""",
    "state_index": f"""with {_E}, dom as (select unnest({EVENT_STATES}) as state,
  unnest({list(range(len(EVENT_STATES)))}) as idx)
select site, dom.state, idx, count(*) as n from st join dom on dom.state = st.state group by all""",
    "state_sequences_events": _sequences_oracle(_E),
    "state_sequences_orders": _sequences_oracle(_O),
    "state_pairs_events": _pairs_oracle(_E),
    "state_pairs_orders": _pairs_oracle(_O),
    "transition_counts_events": _counts_oracle(_E),
    "transition_counts_orders": _counts_oracle(_O),
    "transition_matrix_events": _matrix_oracle(_E, EVENT_STATES),
    "transition_matrix_orders": _matrix_oracle(_O, ORDER_STATES, 1),
    "transition_matrix_laplace": _matrix_oracle(_E, WITH_REFUND),
    "matrix_row_stats": f"""with {_E}, {matrix_sql(EVENT_STATES, 1)}
select src, best, round(rs, 6) + 0.0 as row_sum, round(lo, 6) + 0.0 as row_min,
  round(hi, 6) + 0.0 as row_max, round(g, 6) + 0.0 as row_entropy from r""",
    "matrix_col_sums": f"{_EVENT_M} select dst, round(sum(p), 6) + 0.0 as col_sum from m group by dst",
    "matrix_add": f"""{_EVENT_M} select src, dst, src_idx, dst_idx,
  round(p + support + case when support > 0 then 1 else 0 end, 6) + 0.0 as p from m""",
    "matrix_set_row": f"""{_EVENT_M} select src, dst, src_idx, dst_idx,
  case when support > 0 then support::double else p end as p from m where src = 'view'""",
    "matrix_text": f"""{_EVENT_M}, l as (select src_idx,
  string_agg(cast(round(p, 3) + 0.0 as varchar), ',' order by dst_idx) as line from m group by src_idx)
select string_agg(line, ';' order by src_idx) as matrix from l""",
    "matrix_text_roundtrip": f"""{_EVENT_M}
select src, dst, src_idx, dst_idx, round(p, 6) + 0.0 as p from m""",
    "missprob_events": metric_oracle(_E, EVENT_STATES, "missprob"),
    "missrate_events": metric_oracle(_E, EVENT_STATES, "missrate"),
    "entreduc_events": metric_oracle(_E, EVENT_STATES, "entreduc"),
    "missprob_orders": metric_oracle(_O, ORDER_STATES, "missprob"),
    "missrate_orders": metric_oracle(_O, ORDER_STATES, "missrate"),
    "entreduc_orders": metric_oracle(_O, ORDER_STATES, "entreduc", 1),
    "missprob_laplace": metric_oracle(_E, WITH_REFUND, "missprob"),
    "markov_flags_events": flags_oracle(_E, EVENT_STATES, "missrate", 0.8),
    "markov_flags_orders": flags_oracle(_O, ORDER_STATES, "missprob", 55.0),
    "markov_detect": flags_oracle(_E, EVENT_STATES, "missprob", 0.8, 1),
    "markov_score_by_other": f"""with {_O}, {_ORDERS_BY_PRIORITY},
{matrix_sql(ORDER_STATES, 100, "2")}, {scored_sql("entreduc", "2")} {flags_select(0.6)}""",
    "sparse_dense": _matrix_oracle(_E, WITH_REFUND),
    "sparse_row_stats": f"""with {_E}, {matrix_sql(WITH_REFUND, 1)}
select src, best, round(rs, 6) + 0.0 as row_sum, round(lo, 6) + 0.0 as row_min,
  round(hi, 6) + 0.0 as row_max, round(g, 6) + 0.0 as row_entropy from r""",
    "sparse_col_sums": f"""with {_E}, {matrix_sql(WITH_REFUND, 100)}
select dst, round(sum(p), 6) + 0.0 as col_sum from m group by dst""",
    "sparse_missrate_parts": _parts_sql("avg(case when best = dst then 0.0::double else 1 end)"),
    "sparse_entreduc_parts": _parts_sql("sum(g + p * ln(p)) / sum(g)"),
    "sparse_missprob_other_parts": _parts_sql("avg(rs - p)", "usr::int % 2 = 1", "usr::int % 2 = 0", 9),
}
ORACLE["sparse_score_by_other"] = ORACLE["markov_score_by_other"]
