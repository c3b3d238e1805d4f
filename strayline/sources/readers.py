"""Input by source name.

A source is a Spark data source format and its options. FILE and MYSQL read with Spark alone (plus
a JDBC driver); the others need the connector of their store on the classpath and get their
options passed through.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strayline.sources.store import read_records

# Format and default options of each source.
SOURCES: dict[str, tuple[str, dict[str, str]]] = {
    "FILE": ("parquet", {}),
    "MYSQL": ("jdbc", {}),
    "ELASTIC": ("org.elasticsearch.spark.sql", {"es.nodes": "localhost", "es.port": "9200"}),
    "MONGODB": ("mongodb", {}),
    "CASSANDRA": ("org.apache.spark.sql.cassandra", {"spark.cassandra.connection.host": "127.0.0.1"}),
    "HBASE": ("org.apache.hadoop.hbase.spark", {"spark.hbase.host": "127.0.0.1"}),
}
# Options a source cannot do without (each entry: one of these names).
_NEEDED = {
    "FILE": [("path",)],
    "MYSQL": [("url",), ("database",), ("user",), ("password",), ("dbtable", "query")],
    "ELASTIC": [("es.resource",)],
    "MONGODB": [("mongo.input.uri", "connection.uri")],
    "CASSANDRA": [("keyspace",), ("table",)],
    "HBASE": [("hbase.table",)],
}


def source_options(source: str, **options: Any) -> tuple[str, dict[str, str]]:
    """Format and reader options of a source; ValueError if unknown or incomplete.

    MYSQL: ``url`` is host and port. For a large table also pass ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions``, else one task reads it all.
    ELASTIC: ``es_resource`` is the index, ``es_query`` the predicate run by the store.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown source '{source}', expected one of {', '.join(SOURCES)}")
    name, defaults = SOURCES[source]
    given = {k: str(v) for k, v in options.items() if v is not None}
    # keyword arguments cannot hold dots
    prefixes = ("es_", "mongo_input_", "connection_", "hbase_", "spark_")
    given = {k.replace("_", ".") if k.startswith(prefixes) else k: v for k, v in given.items()}
    missing = [" or ".join(alt) for alt in _NEEDED[source] if not any(k in given for k in alt)]
    if missing:
        raise ValueError(f"source {source} needs the option(s) {', '.join(missing)}")
    if source == "FILE":
        name = given.pop("format", name)
    if source == "MYSQL":
        given["url"] = f"jdbc:mysql://{given['url']}/{given.pop('database')}"
    if "mongo.input.uri" in given:
        given["connection.uri"] = given.pop("mongo.input.uri")
    return name, {**defaults, **given}


def read_source(spark: SparkSession, source: str, schema: Any = None, **options: Any) -> DataFrame:
    """Read a source. For FILE the ``format`` option is parquet, csv, json or orc, or ``tracked`` for
    a table of `create_store`.

    Text files should come with a ``schema``: without one every column of a csv file is text.
    """
    name, opts = source_options(source, **options)
    if name == "tracked":
        return read_records(spark, opts["path"])
    reader = spark.read.format(name).options(**opts)
    return (reader.schema(schema) if schema is not None else reader).load()
