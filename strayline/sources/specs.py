"""Field specs: which source column holds which logical field, and as what type."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from strayline.functions import epoch_micros
from strayline.sources.store import check_uid, read_table, table_path


class Field(NamedTuple):
    name: str
    datatype: str
    value: str


# Logical field, type, source column.
DEFAULT_SPECS = {
    "vector": [
        Field("row", "long", "row"),
        Field("col", "long", "col"),
        Field("lbl", "string", "label"),
        Field("val", "double", "value"),
    ],
    "state": [
        Field("site", "string", "site"),
        Field("user", "string", "user"),
        Field("timestamp", "long", "timestamp"),
        Field("state", "string", "state"),
    ],
}
# Type names of a spec and the Spark type each one stands for.
DATATYPES = {"long": "bigint", "integer": "int", "string": "string", "double": "double"}

_SCHEMA = "position int, name string, datatype string, value string"


def check_kind(kind: str) -> str:
    if kind not in DEFAULT_SPECS:
        raise ValueError(f"unknown kind '{kind}', expected one of {', '.join(DEFAULT_SPECS)}")
    return kind


def apply_field_spec(
    df: DataFrame, spec: Sequence[Field], tiebreak: str | None = None
) -> DataFrame:
    """Select and cast the fields of a spec; a value that does not fit its type is an error.

    A timestamp read as ``long`` becomes microseconds. ``tiebreak`` names one more source column
    to carry along, for the order of events of the same time.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def mapped(f: Field):
        if f.datatype not in DATATYPES:
            raise ValueError(f"unknown datatype '{f.datatype}' of field '{f.name}'")
        if f.datatype == "long" and f.value in types:
            return epoch_micros(f.value, types[f.value]).alias(f.name)
        return F.col(f.value).cast(DATATYPES[f.datatype]).alias(f.name)

    extra = [F.col(tiebreak).alias("tiebreak")] if tiebreak else []
    return df.select(*[mapped(Field(*f)) for f in spec], *extra)


def register_fields(
    spark: SparkSession, store: str, uid: str, spec: Sequence[Field]
) -> None:
    """Keep a spec for later runs of ``uid``; registering again replaces it."""
    rows = [(i, *Field(*f)) for i, f in enumerate(spec)]
    fields = spark.createDataFrame(rows, _SCHEMA).coalesce(1)
    fields.write.mode("overwrite").parquet(table_path(store, "fields", check_uid(uid)))


def read_fields(spark: SparkSession, store: str, uid: str) -> DataFrame:
    """The registered spec ``(uid, name, datatype, value)``; LookupError if there is none."""
    fields = read_table(spark, store, "fields", uid).orderBy("position")
    return fields.select("uid", "name", "datatype", "value")


def field_spec(spark: SparkSession, store: str, uid: str, kind: str) -> list[Field]:
    """The spec registered for ``uid``, else the default one of its kind."""
    check_kind(kind)
    try:
        registered = read_fields(spark, store, uid)
    except LookupError:
        return DEFAULT_SPECS[kind]
    return [Field(r["name"], r["datatype"], r["value"]) for r in registered.collect()]
