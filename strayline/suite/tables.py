"""The test tables in the forms the operators read, and the same in SQL."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strayline.sources.specs import Field, apply_field_spec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0 turns -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


# --- state events -----------------------------------------------------------------------------

EVENT_STATES = ["click", "error", "purchase", "signup", "view"]
ORDER_STATES = ["F", "O", "P"]
ORDER_SPEC = [
    Field("site", "string", "o_orderpriority"),
    Field("user", "string", "o_custkey"),
    Field("timestamp", "long", "o_orderdate"),
    Field("state", "string", "o_orderstatus"),
]
EVENT_SPEC = [
    Field("site", "string", "site"),
    Field("user", "string", "user_id"),
    Field("timestamp", "long", "ts"),
    Field("state", "string", "event_type"),
]


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: one sequence per user."""
    events = table(spark, sf_dir, "events").withColumn("site", F.lit("all"))
    return apply_field_spec(events, EVENT_SPEC, tiebreak="event_id")


def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: one sequence of order statuses per customer."""
    orders = table(spark, sf_dir, "orders").withColumn("site", F.lit("all"))
    spec = [Field("site", "string", "site"), *ORDER_SPEC[1:]]
    return apply_field_spec(orders, spec, tiebreak="o_orderkey")


EVENT_STATES_SQL = """st as (select 'all' as site, cast(user_id as varchar) as usr, epoch_us(ts) as t,
  event_id as tb, event_type as state from events)"""
ORDER_STATES_SQL = """st as (select 'all' as site, cast(o_custkey as varchar) as usr,
  epoch_us(o_orderdate) as t, o_orderkey as tb, o_orderstatus as state from orders)"""

# --- points -----------------------------------------------------------------------------------

LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_returnflag").alias("label"),
        F.array(*LINEITEM_FEATURES).alias("features"),
    )


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def mean_centers(points: DataFrame, cluster: Column) -> DataFrame:
    """Mean vector of each group of points: a center table taken from the data."""
    return (
        points.groupBy(cluster.cast("int").alias("cluster"))
        .agg(Summarizer.mean(array_to_vector("features")).alias("mean"))
        .select("cluster", vector_to_array("mean").alias("center"))
    )


EMBEDDING_SQL = """e as (select vec_id as id, cast(label as varchar) as label, label as cluster,
  unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings)"""
# every point with its nearest label mean; ties go to the lowest label
ASSIGNED_SQL = f"""{EMBEDDING_SQL},
c as (select cluster, pos, avg(x) as c from e group by all),
d as (select e.id, e.label, c.cluster, sqrt(sum((x - c.c) * (x - c.c))) as distance
  from e join c on c.pos = e.pos group by all),
a as (select id, label, min(distance) as distance,
  arg_min(cluster, struct_pack(a := distance, b := cluster)) as cluster from d group by id, label)"""
