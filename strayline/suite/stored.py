"""Queries through the store: written by one job, read back by another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strayline.operators.clusters import assign_nearest, top_per_cluster
from strayline.operators.markov import sequence_metrics, transition_matrix
from strayline.operators.matrix_lines import read_matrix_lines, write_matrix_lines
from strayline.operators.sparse import dense, sparse_matrix
from strayline.operators.support import add_support, store_support, stored_matrix, train_support
from strayline.plans.detect import run_detection
from strayline.sources.readers import read_source
from strayline.sources.loaders import load_points, load_states
from strayline.sources.specs import apply_field_spec, field_spec, register_fields
from strayline.sources.store import (
    append_records,
    create_store,
    read_params,
    read_records,
    read_results,
    scratch_folder,
    write_results,
)
from strayline.suite import points, states
from strayline.suite.tables import (
    ASSIGNED_SQL,
    ORDER_SPEC,
    ORDER_STATES,
    embedding_points,
    mean_centers,
    rounded,
    table,
)

RUN = "run-1"


def q_results_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farthest embeddings of each label mean, stored and read by their run."""
    store = scratch_folder(spark)
    vectors = embedding_points(spark, sf_dir)
    assigned = assign_nearest(vectors, mean_centers(vectors, F.col("label")))
    write_results(top_per_cluster(assigned, 3), store, RUN, "vector")
    return read_results(spark, store, RUN, "vector").select(
        "uid", "cluster", "id", "label", rounded("distance").alias("distance")
    )


def q_run_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run on the orders: registered fields, detection, stored result and parameters.

    The flag is derived again from the stored threshold and must equal the stored one.
    """
    store = scratch_folder(spark)
    register_fields(spark, store, RUN, ORDER_SPEC)
    found = run_detection(
        spark, store, RUN, "MARKOV", "FILE",
        {"path": f"{sf_dir}/orders.parquet", "tiebreak": "o_orderkey"},
        scale=100, states=",".join(ORDER_STATES), strategy="missrate", threshold=0.5,
    )
    threshold = (
        read_params(spark, store, RUN).where(F.col("name") == "threshold")
        .select(F.col("value").cast("double").alias("threshold")).scalar()
    )
    return found.withColumn("threshold", threshold).select(
        "uid", "site", "user", rounded("metric").alias("metric"), "flag",
        F.when(F.col("metric") > F.col("threshold"), "yes").otherwise("no").alias("again"),
    )


def _stored_cells(spark: SparkSession, vectors: DataFrame) -> str:
    """Points as a table of feature cells, tracked under the default column names."""
    path = f"{scratch_folder(spark)}/cells"
    cells = vectors.select(F.col("id").alias("row"), "label", F.posexplode("features").alias("col", "value"))
    create_store(spark, path, "row long, col long, label string, value double")
    append_records(cells, path)
    return path


def q_load_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells stored, read as a source with the default field spec, and assembled."""
    return load_points(spark, "FILE", path=_stored_cells(spark, embedding_points(spark, sf_dir)), format="tracked").select(
        "id", "label", F.posexplode("features").alias("pos", "val")
    )


def q_run_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run on the cells of points whose best clustering is known, with a stored parameter
    beside the result; all of the sweep that is not below the true number of clusters agrees."""
    store = scratch_folder(spark)
    path = _stored_cells(spark, points.separated_points(spark, sf_dir))
    found = run_detection(
        spark, store, RUN, "KMEANS", "FILE", {"path": path, "format": "tracked"},
        top=points.TOP, iterations=points.ITERATIONS, strategy="entropy",
    )
    top = read_params(spark, store, RUN).where("name = 'top'").select("value").scalar()
    return found.select("uid", "id", "label", rounded("distance").alias("distance"), top.cast("int").alias("top"))


def q_registered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders read by a spec that was registered before."""
    store = scratch_folder(spark)
    register_fields(spark, store, RUN, ORDER_SPEC)
    orders = read_source(spark, "FILE", path=f"{sf_dir}/orders.parquet")
    return apply_field_spec(orders, field_spec(spark, store, RUN, "state"))


def q_store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and closed orders appended one after the other to a table of tracked records; the second
    batch is sent again, as after a lost answer."""
    path = f"{scratch_folder(spark)}/tracked"
    orders = load_states(spark, "FILE", ORDER_SPEC, path=f"{sf_dir}/orders.parquet")
    create_store(spark, path, orders.schema)
    is_open = F.col("state") == "O"
    append_records(orders.where(is_open), path, "open")
    for _ in range(2):
        append_records(orders.where(~is_open), path, "closed")
    return read_records(spark, path)


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events up to the middle of their time, and those after."""
    events = states.event_states(spark, sf_dir)
    middle = events.agg((F.min("timestamp") + (F.max("timestamp") - F.min("timestamp")) / 2).alias("m")).scalar()
    timed = events.withColumn("_m", middle)
    return [timed.where(of_half).drop("_m") for of_half in (F.col("timestamp") <= F.col("_m"), F.col("timestamp") > F.col("_m"))]


def q_support_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the first half, the second added: the matrix of all events."""
    first, second = _halves(spark, sf_dir)
    counts = add_support(train_support(first), second).counts
    return dense(sparse_matrix(counts, states.WITH_REFUND)).withColumn("p", rounded("p"))


def q_support_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves kept in a store, the second one sent twice; the second is scored by what is kept."""
    store = scratch_folder(spark)
    first, second = _halves(spark, sf_dir)
    store_support(first, store, RUN, "first")
    for _ in range(2):
        store_support(second, store, RUN, "second")
    matrix = stored_matrix(spark, store, RUN, states.EVENT_STATES)
    scored = sequence_metrics(second, matrix, None, "missprob")
    return scored.withColumn("metric", rounded("metric"))


def q_matrix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of the events written as lines of text and read again."""
    path = f"{scratch_folder(spark)}/matrix"
    write_matrix_lines(transition_matrix(states.event_states(spark, sf_dir), states.WITH_REFUND), path)
    return read_matrix_lines(spark, path, states.WITH_REFUND).withColumn("p", rounded("p"))


QUERIES = {
    "matrix_lines_roundtrip": q_matrix_lines,
    "support_added": q_support_added,
    "support_stored": q_support_stored,
    "results_roundtrip_points": q_results_points,
    "load_points": q_load_points,
    "run_markov_stored": q_run_markov,
    "kmeans_run_stored": q_run_kmeans,
    "registered_fields": q_registered_fields,
    "store_append": q_store_append,
}

_WHOLE = states.EVENT_STATES_SQL.replace("st as", "st1 as")
_BY_PRIORITY = states.ORDER_STATES_SQL.replace("'all'", "o_orderpriority")

ORACLE = {
    "results_roundtrip_points": f"""with {ASSIGNED_SQL},
r as (select *, row_number() over (partition by cluster order by distance desc, id) as rn from a)
select '{RUN}' as uid, cluster, id, label, round(distance, 6) + 0.0 as distance
from r where rn <= 3""",
    "load_points": points.ORACLE["assemble_points_embeddings"],
    "kmeans_run_stored": f"select '{RUN}' as uid, *, {points.TOP} as top from ({points.SEPARATED})",
    "run_markov_stored": f"""with {_BY_PRIORITY}, {states.matrix_sql(ORDER_STATES, 100)},
{states.scored_sql("missrate")}, f as ({states.flags_select(0.5)})
select '{RUN}' as uid, site, "user", metric, flag, flag as again from f""",
    "registered_fields": states.ORACLE["field_mapping_orders"],
    "store_append": states.ORACLE["field_mapping_orders"],
    "support_added": states.ORACLE["transition_matrix_laplace"],
    "support_stored": f"""with {_WHOLE}, {states.matrix_sql(states.EVENT_STATES, 100, "1")},
st as (select st1.* from st1, (select min(t) + (max(t) - min(t)) / 2 as middle from st1) where t > middle),
{states.scored_sql("missprob", "1")} select site, usr as "user", round(metric, 6) + 0.0 as metric from sc""",
    "matrix_lines_roundtrip": f"select src, dst, src_idx, dst_idx, p from ({states.ORACLE['transition_matrix_laplace']})",
}
