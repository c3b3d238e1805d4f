"""Store of runs: results, parameters and field specs as tables under one folder.

Every table has one ``uid=...`` folder per run, so reading a run touches only its own files, and
writing one is a single job that commits as a whole. Tracked records come in batches, each in a
folder of its own, and a list of commits says which folders count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from strayline.sources.files import create_new, exists, remove

# Topics of a result request and the table each one is kept in.
RESULT_TABLES = {"vector": "points", "state": "outliers"}

_PARAMS = "name string, datatype string, value string"


def check_uid(uid: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", uid):
        raise ValueError(f"uid '{uid}' must consist of letters, digits and _ . -")
    return uid


def table_path(store: str, table: str, uid: str) -> str:
    return f"{store}/{table}/uid={uid}"


def _result_table(kind: str) -> str:
    if kind not in RESULT_TABLES:
        raise ValueError(f"unknown task '{kind}', expected one of {', '.join(RESULT_TABLES)}")
    return RESULT_TABLES[kind]


def read_table(spark: SparkSession, store: str, table: str, uid: str) -> DataFrame:
    """The rows of one run; LookupError if it has none."""
    try:
        rows = spark.read.parquet(table_path(store, table, check_uid(uid)))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise LookupError(f"{table} of uid '{uid}' do not exist") from e
    return rows.select(F.lit(uid).alias("uid"), "*")


def write_results(df: DataFrame, store: str, uid: str, kind: str) -> None:
    """Keep the result of a run; refused if ``uid`` already has one."""
    df.write.mode("errorifexists").parquet(table_path(store, _result_table(kind), check_uid(uid)))


def read_results(spark: SparkSession, store: str, uid: str, kind: str) -> DataFrame:
    """Read a stored result: kind ``vector`` for points, ``state`` for sequences."""
    return read_table(spark, store, _result_table(kind), uid)


def check_new(spark: SparkSession, store: str, uid: str) -> None:
    """Raise ValueError if a run of this ``uid`` has stored its result."""
    for table in RESULT_TABLES.values():
        try:
            read_table(spark, store, table, uid)
        except LookupError:
            continue
        raise ValueError(f"uid '{uid}' has already been run")


@contextmanager
def claimed(spark: SparkSession, store: str, uid: str) -> Iterator[None]:
    """Hold ``uid`` for one run: while it is held, or once it has a result, others get ValueError.

    The claim is a file that only one can make. It goes when the run ends, whether it succeeded or
    failed; a driver that was killed leaves it, and `release` takes it away.
    """
    path = f"{store}/claims/{check_uid(uid)}"
    if not create_new(spark, path, spark.sparkContext.applicationId):
        raise ValueError(f"uid '{uid}' is being run; if that run was killed, release the uid first")
    try:
        check_new(spark, store, uid)
        yield
    finally:
        remove(spark, path)


def release(spark: SparkSession, store: str, uid: str) -> None:
    """Take away the claim that a killed run has left."""
    remove(spark, f"{store}/claims/{check_uid(uid)}")


def write_params(
    spark: SparkSession, store: str, uid: str, params: dict[str, tuple[str, Any]]
) -> None:
    """Keep the parameters of a run, given as ``name: (datatype, value)``."""
    rows = [(name, datatype, str(value)) for name, (datatype, value) in params.items()]
    frame = spark.createDataFrame(rows, _PARAMS).coalesce(1)
    frame.write.mode("errorifexists").parquet(table_path(store, "params", check_uid(uid)))


def read_params(spark: SparkSession, store: str, uid: str) -> DataFrame:
    """The parameters of a run: ``(uid, name, datatype, value)``."""
    return read_table(spark, store, "params", uid)


def create_store(spark: SparkSession, path: str, schema: StructType | str) -> None:
    """Create an empty table for tracked records; refused if the path has one."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("errorifexists").parquet(f"{path}/schema")


def append_records(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append records to a table made by `create_store`, as its columns in its types.

    A missing column or a value that does not fit is an error. A ``batch`` is added once: a repeated
    or concurrent attempt to add it adds nothing and returns False. Every attempt writes a folder of
    its own, and the one file that commits the batch names the folder that counts; so readers see
    whole batches, and what a failed attempt has written is never read.
    """
    spark = df.sparkSession
    batch = check_uid(batch) if batch is not None else uuid4().hex
    commit = f"{path}/commits/{batch}"
    schema = spark.read.parquet(f"{path}/schema").schema
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    records = df.select(*fields)
    if exists(spark, commit):
        return False
    folder = f"{batch}-{uuid4().hex}"
    records.write.parquet(f"{path}/data/{folder}")
    if create_new(spark, commit, folder):
        return True
    remove(spark, f"{path}/data/{folder}")
    return False


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all committed batches of a table made by `create_store`."""
    schema = spark.read.parquet(f"{path}/schema").schema
    folders = []
    if exists(spark, f"{path}/commits"):
        folders = [r["value"] for r in spark.read.text(f"{path}/commits").collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f in sorted(folders)])


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name under the shared folder of the cluster, or else under the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/strayline-{uuid4().hex}"


def write_scratch(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to a new scratch folder and read from there."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
