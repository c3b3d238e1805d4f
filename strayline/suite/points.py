"""Queries on points: statistics, z-scores, entropies, assignment and clustering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strayline.functions import euclidean
from strayline.operators.clusters import (
    assign_nearest,
    best_k,
    center_distance,
    cluster_distance,
    cluster_entropy,
    top_per_cluster,
)
from strayline.operators.entropy import int_entropy, str_entropy
from strayline.operators.vectors import assemble_points, feature_stats, zscore
from strayline.plans.detect import detect_outliers
from strayline.plans.kmeans import (
    SWEEP_KS,
    assign_by_model,
    detect_kmeans,
    find_kmeans_outliers,
    fit_kmeans,
    model_centers,
    prepare,
    sweep_k,
)
from strayline.suite.tables import (
    ASSIGNED_SQL,
    EMBEDDING_SQL,
    LINEITEM_FEATURES,
    embedding_points,
    lineitem_points,
    mean_centers,
    rounded,
    table,
)

ITERATIONS = 10
TOP = 3


def q_feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_stats(lineitem_points(spark, sf_dir)).select(
        "pos", "n", rounded("total", 2).alias("total"),
        rounded("mean", 7).alias("mean"), rounded("stdev").alias("stdev"),
    )


def q_feature_stats_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_stats(embedding_points(spark, sf_dir)).select(
        "pos", "n", rounded("mean").alias("mean"), rounded("stdev").alias("stdev")
    )


def q_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zscore(lineitem_points(spark, sf_dir)).select(
        "id", "label", *[rounded(F.get("features", i)).alias(f"z{i}") for i in range(4)]
    )


def q_zscore_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        zscore(embedding_points(spark, sf_dir))
        .select("id", "label", F.posexplode("features").alias("pos", "z"))
        .withColumn("z", rounded("z"))
    )


def q_assemble_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per order, as cells, back to points."""
    totals = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *[F.sum(c).alias(c) for c in LINEITEM_FEATURES], F.min("l_returnflag").alias("lbl")
    )
    values = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("val"))
                       for i, c in enumerate(LINEITEM_FEATURES)])
    cells = totals.select(F.col("l_orderkey").alias("row"), "lbl", F.inline(values))
    return assemble_points(cells).select(
        "id", "label", *[F.round(F.get("features", i), 2).alias(f"f{i}") for i in range(4)]
    )


def q_assemble_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row"),
        F.col("label").cast("string").alias("lbl"),
        F.posexplode(F.col("embedding").cast("array<double>")).alias("col", "val"),
    )
    return assemble_points(cells).select(
        "id", "label", F.posexplode("features").alias("pos", "val")
    )


def q_str_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return str_entropy(lines, ["l_linestatus"], "l_returnflag").withColumn(
        "entropy", rounded("entropy")
    )


def q_str_entropy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return str_entropy(events, ["user_id"], "event_type").withColumn("entropy", rounded("entropy"))


def q_int_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole account balances as weights; negative ones do not count."""
    customers = table(spark, sf_dir, "customer").select(
        "c_nationkey", F.floor("c_acctbal").alias("weight")
    )
    return int_entropy(customers, ["c_nationkey"], "weight").withColumn(
        "entropy", rounded("entropy")
    )


def q_int_entropy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return int_entropy(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_linenumber"
    ).withColumn("entropy", rounded("entropy"))


def _label_centers(points: DataFrame) -> DataFrame:
    return mean_centers(points, F.col("label"))


def q_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every embedding to the mean of all of them."""
    points = embedding_points(spark, sf_dir)
    mean = mean_centers(points, F.lit(0)).select("center").scalar()
    return points.withColumn("mean", mean).select(
        "id", rounded(euclidean("features", "mean")).alias("distance")
    )


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = embedding_points(spark, sf_dir)
    return assign_nearest(points, _label_centers(points))


def q_assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select(
        "id", "label", "cluster", rounded("distance").alias("distance")
    )


def q_assign_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's nearest part by size and price: a center table that no task holds whole."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_returnflag").alias("label"),
        F.array("l_quantity", F.col("l_extendedprice") / F.col("l_quantity")).alias("features"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("cluster"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("center")
    )
    return assign_nearest(lines, parts, local_values=2000).select(
        "id", "label", "cluster", rounded("distance").alias("distance")
    )


def q_center_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every embedding to the mean of its own label."""
    points = embedding_points(spark, sf_dir)
    labeled = points.withColumn("cluster", F.col("label").cast("int"))
    return center_distance(labeled, _label_centers(points)).select(
        "id", "cluster", rounded("distance").alias("distance")
    )


def q_cluster_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_entropy(_assigned(spark, sf_dir)).select(rounded("score").alias("score"))


def q_cluster_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_distance(_assigned(spark, sf_dir)).select(rounded("score").alias("score"))


def q_top_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_cluster(_assigned(spark, sf_dir), TOP).select(
        "cluster", "id", "label", rounded("distance").alias("distance")
    )


def _pinned_scores(spark: SparkSession, sf_dir: str, score) -> DataFrame:
    """Scores of center tables that do not depend on a fit: means of the points by id modulo k."""
    points = embedding_points(spark, sf_dir)
    scores = [
        score(assign_nearest(points, mean_centers(points, F.col("id") % k))).select(
            F.lit(k).alias("k"), "score"
        )
        for k in SWEEP_KS
    ]
    return reduce(DataFrame.unionByName, scores)


def q_best_k_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_k(_pinned_scores(spark, sf_dir, cluster_distance))
    return best.select("k", rounded("score").alias("score"))


def q_best_k_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_k(_pinned_scores(spark, sf_dir, cluster_entropy))
    return best.select("k", rounded("score").alias("score"))


def q_find_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_kmeans_outliers(
        embedding_points(spark, sf_dir), "distance", iterations=ITERATIONS, top=TOP
    )


def q_detect_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_outliers(
        lineitem_points(spark, sf_dir), "KMEANS",
        strategy="distance", iterations=ITERATIONS, top=10,
    )


SEPARATE = 10


def separated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings moved far apart by label: the best clustering is known, one cluster per residue."""
    moved = F.transform(
        "features",
        lambda x, i: x + F.when(i % SEPARATE == F.col("label").cast("int") % SEPARATE, 1000.0).otherwise(0.0),
    )
    return embedding_points(spark, sf_dir).withColumn("features", moved)


def _far(found: DataFrame) -> DataFrame:
    return found.select("id", "label", rounded("distance").alias("distance"))


def _sweep_separated(strategy: str):
    """Scores at the true number of clusters, where the best clustering is known."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scores = sweep_k(zscore(separated_points(spark, sf_dir)), strategy, ITERATIONS, ks=(2, SEPARATE))
        return scores.where(F.col("k") == SEPARATE).select("k", rounded("score").alias("score"))

    return run


def q_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen k, and every normalized feature with all of its digits but the last few."""
    k, normalized = prepare(separated_points(spark, sf_dir), "entropy", ITERATIONS)
    return normalized.select(F.lit(k).alias("k"), "id", "label", F.posexplode("features").alias("pos", "z")).withColumn(
        "z", rounded("z")
    )


def q_find_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sweep: from the true number of clusters on no cluster is mixed, and the least such
    k is chosen."""
    return _far(find_kmeans_outliers(separated_points(spark, sf_dir), "entropy", iterations=ITERATIONS, top=TOP))


def q_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dispatch to the clustering detector."""
    points = separated_points(spark, sf_dir)
    return _far(detect_outliers(points, "KMEANS", strategy="distance", iterations=ITERATIONS, top=TOP, ks=(5, SEPARATE)))


def q_detect_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _far(detect_kmeans(zscore(separated_points(spark, sf_dir)), SEPARATE, ITERATIONS, TOP))


def q_find_separated_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways to choose k take the number of true clusters."""
    points = separated_points(spark, sf_dir)
    return _far(find_kmeans_outliers(points, "entropy", iterations=ITERATIONS, top=TOP, ks=(2, SEPARATE)))


def q_find_separated_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = separated_points(spark, sf_dir)
    return _far(find_kmeans_outliers(points, "distance", iterations=ITERATIONS, top=TOP, ks=(2, SEPARATE)))


def q_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of the embeddings as they are: points per k, and how many of them break a rule.

    A point's own center is its nearest; each cluster keeps its TOP points or all it has, and no
    point left out is farther than one that is kept.
    """
    points = zscore(embedding_points(spark, sf_dir))

    def checked(k: int) -> DataFrame:
        model = fit_kmeans(points, k, ITERATIONS)
        assigned = assign_by_model(points, model)
        kept = top_per_cluster(assigned, TOP).groupBy("cluster").agg(
            F.count("*").alias("kept"), F.min("distance").alias("least")
        )
        least = assign_nearest(points, model_centers(model, points)).select("id", F.col("distance").alias("nearest"))
        of_cluster = Window.partitionBy("cluster")
        beyond = F.count_if(F.col("distance") > F.col("least"))
        rows = assigned.join(least, "id").withColumn("size", F.count("*").over(of_cluster)).join(kept, "cluster")
        wrong = (F.col("kept") != F.least(F.col("size"), F.lit(TOP))).cast("long")
        clusters = rows.groupBy("cluster").agg(
            F.count("*").alias("points"),
            F.count_if(F.abs(F.col("distance") - F.col("nearest")) > 1e-9).alias("not_nearest"),
            F.max(wrong).alias("wrong"),
            F.greatest(beyond - F.max("kept") + 1, F.lit(0)).alias("left_out_farther"),
        )
        return clusters.agg(
            F.lit(k).alias("k"), F.sum("points").alias("points"), F.sum("not_nearest").alias("not_nearest"),
            F.sum("wrong").alias("wrong_kept"), F.sum("left_out_farther").alias("left_out_farther"),
        )

    return checked(5).union(checked(10))


QUERIES = {
    "kmeans_invariants": q_invariants,
    "kmeans_detect_separated": q_detect_separated,
    "kmeans_find_separated_entropy": q_find_separated_entropy,
    "kmeans_find_separated_distance": q_find_separated_distance,
    "feature_stats": q_feature_stats,
    "feature_stats_embeddings": q_feature_stats_embeddings,
    "zscore": q_zscore,
    "zscore_embeddings": q_zscore_embeddings,
    "assemble_points": q_assemble_points,
    "assemble_points_embeddings": q_assemble_embeddings,
    "str_entropy": q_str_entropy,
    "str_entropy_users": q_str_entropy_users,
    "int_entropy": q_int_entropy,
    "int_entropy_lineitem": q_int_entropy_lineitem,
    "euclidean": q_euclidean,
    "assign_nearest": q_assign_nearest,
    "assign_nearest_many": q_assign_many,
    "center_distance": q_center_distance,
    "cluster_entropy": q_cluster_entropy,
    "cluster_distance": q_cluster_distance,
    "top_per_cluster": q_top_per_cluster,
    "best_k_distance": q_best_k_distance,
    "best_k_entropy": q_best_k_entropy,
    "kmeans_sweep_entropy": _sweep_separated("entropy"),
    "kmeans_sweep_distance": _sweep_separated("distance"),
    "kmeans_prepare": q_prepare,
    "kmeans_find_entropy": q_find_entropy,
    "kmeans_find_distance": q_find_distance,
    "kmeans_detect": q_detect,
    "kmeans_detect_lineitem": q_detect_lineitem,
}


def _stats_sql(column: str, pos: int) -> str:
    return f"""select {pos}::integer as pos, count(*) as n, round(sum({column}), 2) + 0.0 as total,
  round(avg({column}), 7) + 0.0 as mean, round(stddev_pop({column}), 6) + 0.0 as stdev from lineitem"""


def _z_sql(column: str, pos: int) -> str:
    centered = f"{column} - avg({column}) over ()"
    return f"""round(case when stddev_pop({column}) over () > 0
  then ({centered}) / stddev_pop({column}) over () else {centered} end, 6) + 0.0 as z{pos}"""


# nearest center among the means by id modulo k, for all k of the sweep
_PINNED_SQL = f"""with {EMBEDDING_SQL},
ks as (select unnest({list(SWEEP_KS)}) as k),
c as (select k, id % k as cluster, pos, avg(x) as c from e, ks group by all),
d as (select c.k, e.id, e.label, c.cluster, sqrt(sum((x - c.c) * (x - c.c))) as distance
  from e join c on c.pos = e.pos group by all),
a as (select k, id, label, min(distance) as distance,
  arg_min(cluster, struct_pack(a := distance, b := cluster)) as cluster from d group by k, id, label)"""

_ENTROPY_SQL = "-sum(n * 1.0 / t * log2(n * 1.0 / t))"

ORACLE = {
    "feature_stats": " union all ".join(
        _stats_sql(c, i) for i, c in enumerate(LINEITEM_FEATURES)
    ),
    "feature_stats_embeddings": f"""with {EMBEDDING_SQL}
select (pos - 1)::integer as pos, count(*) as n, round(avg(x), 6) + 0.0 as mean,
  round(stddev_pop(x), 6) + 0.0 as stdev from e group by pos""",
    "zscore": "select l_orderkey as id, l_returnflag as label, "
    + ", ".join(_z_sql(c, i) for i, c in enumerate(LINEITEM_FEATURES))
    + " from lineitem",
    "zscore_embeddings": f"""with {EMBEDDING_SQL},
s as (select pos, avg(x) as m, stddev_pop(x) as sd from e group by pos)
select id, label, (e.pos - 1)::integer as pos,
  round(case when sd > 0 then (x - m) / sd else x - m end, 6) + 0.0 as z
from e join s on s.pos = e.pos""",
    "assemble_points": "select l_orderkey as id, min(l_returnflag) as label, "
    + ", ".join(f"round(sum({c}), 2) as f{i}" for i, c in enumerate(LINEITEM_FEATURES))
    + " from lineitem group by l_orderkey",
    "assemble_points_embeddings": f"""with {EMBEDDING_SQL}
select id, label, (pos - 1)::integer as pos, x as val from e""",
    "str_entropy": f"""with c as (select l_linestatus, l_returnflag, count(*) as n,
  sum(count(*)) over (partition by l_linestatus) as t from lineitem
  group by l_linestatus, l_returnflag)
select l_linestatus, round({_ENTROPY_SQL}, 6) + 0.0 as entropy from c group by l_linestatus""",
    "str_entropy_users": f"""with c as (select user_id, event_type, count(*) as n,
  sum(count(*)) over (partition by user_id) as t from events group by user_id, event_type)
select user_id, round({_ENTROPY_SQL}, 6) + 0.0 as entropy from c group by user_id""",
    "int_entropy": """with w as (select c_nationkey, floor(c_acctbal)::bigint as w from customer),
p as (select c_nationkey, w * 1.0 / sum(w) over (partition by c_nationkey) as p from w where w > 0)
select n.c_nationkey, round(coalesce(sum(-p * ln(p)), 0), 6) + 0.0 as entropy
from (select distinct c_nationkey from w) n left join p on p.c_nationkey = n.c_nationkey
group by n.c_nationkey""",
    "int_entropy_lineitem": """with p as (select l_returnflag, l_linestatus,
  l_linenumber * 1.0 / sum(l_linenumber) over (partition by l_returnflag, l_linestatus) as p
  from lineitem where l_linenumber > 0)
select l_returnflag, l_linestatus, round(sum(-p * ln(p)), 6) + 0.0 as entropy from p group by all""",
    "euclidean": f"""with {EMBEDDING_SQL}, m as (select pos, avg(x) as m from e group by pos)
select id, round(sqrt(sum((x - m) * (x - m))), 6) + 0.0 as distance
from e join m on m.pos = e.pos group by id""",
    "assign_nearest": f"""with {ASSIGNED_SQL}
select id, label, cluster, round(distance, 6) + 0.0 as distance from a""",
    "assign_nearest_many": """with p as (select l_orderkey, l_returnflag, l_quantity as x,
  l_extendedprice / l_quantity as y, count(*) as copies from lineitem group by all),
d as (select p.*, arg_min(p_partkey, struct_pack(a := sqrt((x - p_size) * (x - p_size)
    + (y - p_retailprice) * (y - p_retailprice)), b := p_partkey)) as cluster,
  min(sqrt((x - p_size) * (x - p_size) + (y - p_retailprice) * (y - p_retailprice))) as distance
  from p cross join part group by all)
select l_orderkey as id, l_returnflag as label, cluster::int as cluster, round(distance, 6) + 0.0 as distance
from (select *, unnest(range(copies)) from d)""",
    "center_distance": f"""with {EMBEDDING_SQL},
c as (select cluster, pos, avg(x) as c from e group by all)
select id, e.cluster, round(sqrt(sum((x - c) * (x - c))), 6) + 0.0 as distance
from e join c on c.pos = e.pos and c.cluster = e.cluster group by id, e.cluster""",
    "cluster_entropy": f"""with {ASSIGNED_SQL},
n as (select cluster, label, count(*) as n, sum(count(*)) over (partition by cluster) as t
  from a group by cluster, label),
h as (select cluster, {_ENTROPY_SQL} as h from n group by cluster)
select round(avg(h), 6) + 0.0 as score from h""",
    "cluster_distance": f"""with {ASSIGNED_SQL}
select round(avg(distance), 6) + 0.0 as score from a""",
    "top_per_cluster": f"""with {ASSIGNED_SQL},
r as (select *, row_number() over (partition by cluster order by distance desc, id) as rn from a)
select cluster, id, label, round(distance, 6) + 0.0 as distance from r where rn <= {TOP}""",
    "best_k_distance": f"""{_PINNED_SQL}
select k, round(avg(distance), 6) + 0.0 as score from a group by k
order by avg(distance), k limit 1""",
    "best_k_entropy": f"""{_PINNED_SQL},
n as (select k, cluster, label, count(*) as n, sum(count(*)) over (partition by k, cluster) as t
  from a group by k, cluster, label),
h as (select k, cluster, {_ENTROPY_SQL} as h from n group by k, cluster)
select k, round(avg(h), 6) + 0.0 as score from h group by k order by avg(h), k limit 1""",
}

_SEPARATED_Z = f"""with {EMBEDDING_SQL},
m as (select id, label, cluster % {SEPARATE} as g, pos,
  x + case when (pos - 1) % {SEPARATE} = cluster % {SEPARATE} then 1000 else 0 end as x from e),
s as (select pos, avg(x) as mean, stddev_pop(x) as sd from m group by pos),
z as (select id, label, g, pos, (x - mean) / case when sd > 0 then sd else 1 end as z from m join s using (pos)),
c as (select g, pos, avg(z) as c from z group by all),
d as (select id, label, g, sqrt(sum((z - c) * (z - c))) as distance from z join c using (g, pos) group by all)"""
SEPARATED = f"""{_SEPARATED_Z},
r as (select *, row_number() over (partition by g order by distance desc, id) as rn from d)
select id, label, round(distance, 6) + 0.0 as distance from r where rn <= {TOP}"""
ORACLE |= {
    name: SEPARATED
    for name in (
        "kmeans_detect_separated", "kmeans_find_separated_entropy", "kmeans_find_separated_distance",
        "kmeans_find_entropy", "kmeans_detect",
    )
}
ORACLE["kmeans_prepare"] = f"""{_SEPARATED_Z}
select {SEPARATE} as k, id, label, (pos - 1)::integer as pos, round(z, 6) + 0.0 as z from z"""
ORACLE["kmeans_sweep_distance"] = f"""{_SEPARATED_Z}
select {SEPARATE} as k, round(avg(distance), 6) + 0.0 as score from d"""
ORACLE["kmeans_sweep_entropy"] = f"""{_SEPARATED_Z},
n as (select g, label, count(*) as n, sum(count(*)) over (partition by g) as t from d group by g, label),
h as (select g, {_ENTROPY_SQL} as h from n group by g)
select {SEPARATE} as k, round(avg(h), 6) + 0.0 as score from h"""
ORACLE["kmeans_invariants"] = """select unnest([5, 10]) as k, n as points, 0::bigint as not_nearest,
  0::bigint as wrong_kept, 0::bigint as left_out_farther from (select count(*) as n from embeddings)"""
