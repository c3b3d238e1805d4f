"""What the operators share: reading a table, words, cutting lineage, distributed components."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session without one gets a folder under its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/strayline-work").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder and go on from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As `cut`, by a table of compressed columns, whose size Spark knows when it plans what follows."""
    path = f"{shared_folder(df.sparkSession)}/strayline-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda in ``body`` refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(u, v)``: rows ``(node, root)``.

    ``root`` is the least node of the component; a node that is its own root has no row.
    Large stars and small stars take turns until nothing changes: each turn links nodes to smaller
    ones by a minimum per node, so that a node of any degree is a partial aggregate and one row on
    one side of a join. Neither nodes nor edges come to the driver, only their count and a hash.
    """
    up, down = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = cut(edges.where(F.col("u") != F.col("v")).select(up, down).distinct())
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                        F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    )
                ).alias("e")
            )
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        edges = cut(small)
        before, mark = mark, _mark(edges)
        if before == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Rows ``(_id, label)`` to learn from: of each class the ``per_class`` first by a hash.

    Held-out documents (crc32 of ``doc_id`` as text, modulo 3, is 1) and null labels are left out,
    repeated labels count once. At most ``2 * per_class`` rows, whatever the table: small enough to
    broadcast.
    """
    usable = labels.where(~is_held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
    usable = usable.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).distinct()
    order = (F.xxhash64("_id"), F.col("_id"))
    classes = [usable.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    return classes[0].union(classes[1])


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
