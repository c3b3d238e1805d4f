import datetime
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from strayline.plans.detect import detect_outliers, run_detection
from strayline.sources.loaders import load_points, load_states
from strayline.sources.readers import read_source, source_options
from strayline.sources.specs import (
    DEFAULT_SPECS, Field, apply_field_spec, field_spec, read_fields, register_fields,
)
from strayline.sources.store import (
    append_records, claimed, create_store, read_params, read_records, read_results, release, scratch_folder, write_params,
    write_results,
)

CELLS = [(r, c, f"l{r}", r + c / 10) for r in range(1, 5) for c in range(3)]
EVENTS = [("s", f"u{i % 3}", i, "AB"[i * 7 % 5 % 2]) for i in range(30)]


@pytest.fixture
def cells_path(spark, tmp_path):
    spark.createDataFrame(CELLS, "row long, col long, label string, value double").write.parquet(f"{tmp_path}/cells")
    return f"{tmp_path}/cells"


@pytest.fixture
def events_path(spark, tmp_path):
    spark.createDataFrame(EVENTS, "site string, user string, timestamp long, state string").write.parquet(f"{tmp_path}/events")
    return f"{tmp_path}/events"


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_file_source(spark, tmp_path, fmt):
    df = spark.createDataFrame(EVENTS, "site string, user string, timestamp long, state string")
    df.write.format(fmt).save(f"{tmp_path}/x")
    got = read_source(spark, "FILE", schema=df.schema, path=f"{tmp_path}/x", format=fmt)
    assert sorted(map(tuple, got.collect())) == sorted(EVENTS)


def test_unknown_or_incomplete_source(spark):
    with pytest.raises(ValueError, match="unknown source 'FTP'"):
        read_source(spark, "FTP")
    with pytest.raises(ValueError, match="path"):
        read_source(spark, "FILE")
    with pytest.raises(ValueError, match="dbtable or query"):
        source_options("MYSQL", url="h:1", database="d", user="u", password="p")


def test_store_options():
    assert source_options("MYSQL", url="h:8889", database="d", user="u", password="p", dbtable="t", numPartitions=8) == (
        "jdbc",
        {"url": "jdbc:mysql://h:8889/d", "user": "u", "password": "p", "dbtable": "t", "numPartitions": "8"},
    )
    assert source_options("ELASTIC", es_resource="i/t", es_query="?q=x", es_nodes="n") == (
        "org.elasticsearch.spark.sql",
        {"es.nodes": "n", "es.port": "9200", "es.resource": "i/t", "es.query": "?q=x"},
    )
    assert source_options("MONGODB", mongo_input_uri="mongodb://h/db.c")[1] == {"connection.uri": "mongodb://h/db.c"}
    name, options = source_options("CASSANDRA", keyspace="k", table="t", spark_cassandra_connection_host="h")
    assert name == "org.apache.spark.sql.cassandra" and options["spark.cassandra.connection.host"] == "h"
    assert source_options("HBASE", hbase_table="t")[1]["hbase.table"] == "t"


def test_default_specs():
    assert [tuple(f) for f in DEFAULT_SPECS["vector"]] == [
        ("row", "long", "row"), ("col", "long", "col"), ("lbl", "string", "label"), ("val", "double", "value"),
    ]
    assert [f.name for f in DEFAULT_SPECS["state"]] == ["site", "user", "timestamp", "state"]


def test_field_mapping_casts(spark):
    df = spark.createDataFrame([("7", 2, 3.5)], "a string, b int, c double")
    spec = [Field("row", "long", "a"), Field("lbl", "string", "b"), ("val", "double", "c")]
    out = apply_field_spec(df, spec)
    assert out.dtypes == [("row", "bigint"), ("lbl", "string"), ("val", "double")]
    assert tuple(out.first()) == (7, "2", 3.5)
    with pytest.raises(ValueError, match="datatype"):
        apply_field_spec(df, [Field("row", "blob", "a")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        apply_field_spec(spark.createDataFrame([("x",)], "a string"), [Field("row", "long", "a")]).collect()
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        apply_field_spec(df, [Field("row", "long", "missing")])


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_become_microseconds(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql(
            "select timestamp_ntz'2024-03-10 02:30:00.000001' a, timestamp_ntz'1969-12-31 23:59:59.5' b,"
            " timestamp'2024-03-10 12:00:00Z' c"
        )
        got = apply_field_spec(df, [Field(n, "long", n) for n in "abc"]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    micros = datetime.timedelta(microseconds=1)
    epoch = datetime.datetime(1970, 1, 1)
    assert got["a"] == (datetime.datetime(2024, 3, 10, 2, 30, 0, 1) - epoch) // micros
    assert got["b"] == -500_000
    assert got["c"] == (datetime.datetime(2024, 3, 10, 12) - epoch) // micros


def test_loaders(spark, cells_path, events_path):
    points = load_points(spark, "FILE", path=cells_path).orderBy("id").collect()
    assert [r["features"] for r in points] == [[r + c / 10 for c in range(3)] for r in range(1, 5)]
    assert [r["label"] for r in points] == ["l1", "l2", "l3", "l4"]
    assert load_states(spark, "FILE", path=events_path, tiebreak="timestamp").columns == [
        "site", "user", "timestamp", "state", "tiebreak",
    ]


def test_only_mapped_columns_are_read(spark, tmp_path):
    spark.createDataFrame([("s", "u", 1, "A", "x" * 50)], "site string, user string, timestamp long, state string, rest string").write.parquet(f"{tmp_path}/wide")
    plan = load_states(spark, "FILE", path=f"{tmp_path}/wide")._jdf.queryExecution().executedPlan().toString()
    assert "rest" not in plan


def test_field_specs(spark, tmp_path):
    store = str(tmp_path)
    assert field_spec(spark, store, "u1", "state") == DEFAULT_SPECS["state"]
    with pytest.raises(ValueError, match="kind"):
        field_spec(spark, store, "u1", "graph")
    with pytest.raises(LookupError):
        read_fields(spark, store, "u1")
    for source in ("first", "second"):
        register_fields(spark, store, "u1", [Field("site", "string", source), Field("user", "string", "u")])
    assert field_spec(spark, store, "u1", "state") == [("site", "string", "second"), ("user", "string", "u")]
    assert read_fields(spark, store, "u1").columns == ["uid", "name", "datatype", "value"]
    assert field_spec(spark, store, "u2", "vector") == DEFAULT_SPECS["vector"]


def test_results(spark, tmp_path):
    store = str(tmp_path)
    df = spark.createDataFrame([(1, "a")], "id long, label string")
    with pytest.raises(LookupError, match="'007'"):
        read_results(spark, store, "007", "vector")
    write_results(df, store, "007", "vector")
    write_results(df.limit(0), store, "008", "vector")
    assert [tuple(r) for r in read_results(spark, store, "007", "vector").collect()] == [("007", 1, "a")]
    assert read_results(spark, store, "008", "vector").collect() == []
    with pytest.raises(LookupError):
        read_results(spark, store, "007", "state")
    for kind in ("graph", "points"):
        with pytest.raises(ValueError, match="unknown task"):
            read_results(spark, store, "007", kind)
        with pytest.raises(ValueError, match="unknown task"):
            write_results(df, store, "007", kind)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_results(df, store, "007", "vector")
    with pytest.raises(ValueError, match="uid"):
        write_results(df, store, "../x", "vector")


def test_params(spark, tmp_path):
    write_params(spark, str(tmp_path), "u", {"top": ("integer", 3), "threshold": ("double", 0.5)})
    assert sorted(map(tuple, read_params(spark, str(tmp_path), "u").collect())) == [
        ("u", "threshold", "double", "0.5"), ("u", "top", "integer", "3"),
    ]


def test_tracked_records(spark, tmp_path):
    path = f"{tmp_path}/t"
    create_store(spark, path, "id long, name string")
    assert read_records(spark, path).collect() == []
    append_records(spark.createDataFrame([("b", 2)], "name string, id int"), path)
    append_records(spark.createDataFrame([(1, "a")], "id long, name string"), path)
    assert sorted(map(tuple, read_records(spark, path).collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, read_source(spark, "FILE", path=path, format="tracked").collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        append_records(spark.createDataFrame([(1,)], "id long"), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        create_store(spark, path, "id long")


def test_a_batch_is_added_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    create_store(spark, path, "id long")
    one, two = spark.range(3), spark.range(10, 12)
    assert append_records(one, path, "b1") and not append_records(one, path, "b1")
    broken = two.withColumn("id", F.when(F.col("id") > 10, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        append_records(broken, path, "b2")
    two.write.parquet(f"{path}/data/b2-left-behind")  # what an attempt that was killed leaves
    assert read_records(spark, path).count() == 3
    with ThreadPoolExecutor(4) as pool:
        added = list(pool.map(lambda _: append_records(two, path, "b2"), range(4)))
    assert sum(added) == 1
    assert sorted(r["id"] for r in read_records(spark, path).collect()) == [0, 1, 2, 10, 11]


def test_a_uid_is_claimed_by_one(spark, tmp_path, events_path):
    store = f"{tmp_path}/store"
    params = dict(scale=1, states="A,B", strategy="missprob", threshold=0.4)

    def run(_):
        try:
            run_detection(spark, store, "r", "MARKOV", "FILE", {"path": events_path}, **params)
            return "ran"
        except ValueError as e:
            return str(e)

    with ThreadPoolExecutor(3) as pool:
        ended = list(pool.map(run, range(3)))
    assert ended.count("ran") == 1 and all("uid 'r'" in e for e in ended if e != "ran")
    with claimed(spark, store, "held"), pytest.raises(ValueError, match="is being run"):
        run_detection(spark, store, "held", "MARKOV", "FILE", {"path": events_path}, **params)
    with pytest.raises(Exception, match="state not declared"):  # a failed run lets go of its uid
        run_detection(spark, store, "again", "MARKOV", "FILE", {"path": events_path}, **{**params, "states": "A"})
    run_detection(spark, store, "again", "MARKOV", "FILE", {"path": events_path}, **params)


def test_a_claim_left_behind_is_released(spark, tmp_path):
    held = claimed(spark, str(tmp_path), "u")
    held.__enter__()
    with pytest.raises(ValueError, match="release"), claimed(spark, str(tmp_path), "u"):
        pass
    release(spark, str(tmp_path), "u")
    with claimed(spark, str(tmp_path), "u"):
        pass


def test_scratch_folder_is_the_one_the_cluster_names():
    class Session:
        conf = {"spark.checkpoint.dir": "s3a://shared/tmp/"}

    first, second = scratch_folder(Session), scratch_folder(Session)
    assert first.startswith("s3a://shared/tmp/strayline-") and first != second


def test_markov_run(spark, tmp_path, events_path):
    store = f"{tmp_path}/store"
    params = dict(scale=1, states="A,B", strategy="missprob", threshold=0.4)
    got = run_detection(spark, store, "run", "MARKOV", "FILE", {"path": events_path}, **params)
    direct = detect_outliers(load_states(spark, "FILE", path=events_path), "MARKOV", **params)
    assert sorted(map(str, got.drop("uid").collect())) == sorted(map(str, direct.collect()))
    assert {r["name"]: r["value"] for r in read_params(spark, store, "run").collect()} == {"strategy": "missprob", "threshold": "0.4"}
    with pytest.raises(ValueError, match="already been run"):
        run_detection(spark, store, "run", "MARKOV", "FILE", {"path": events_path}, **params)


def test_kmeans_run(spark, tmp_path, cells_path):
    store = f"{tmp_path}/store"
    got = run_detection(
        spark, store, "k", "KMEANS", "FILE", {"path": cells_path}, top=1, iterations=3, strategy="distance"
    ).collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3, 4] and got[0]["uid"] == "k"
    assert {r["name"]: (r["datatype"], r["value"]) for r in read_params(spark, store, "k").collect()} == {
        "top": ("integer", "1"), "strategy": ("string", "distance"), "iterations": ("integer", "3"),
    }


@pytest.mark.parametrize(
    "algorithm, params, message",
    [
        ("KNN", {}, "unknown algorithm"),
        ("KMEANS", dict(iterations=1, strategy="entropy"), "top"),
        ("KMEANS", dict(top=1, strategy="entropy"), "iterations"),
        ("KMEANS", dict(top=1, iterations=1), "strategy"),
        ("KMEANS", dict(top=1, iterations=1, strategy="missprob"), "unknown strategy"),
        ("MARKOV", dict(states="A", strategy="missrate", threshold=1), "scale"),
        ("MARKOV", dict(scale=1, strategy="missrate", threshold=1), "states"),
        ("MARKOV", dict(scale=1, states="A", threshold=1), "strategy"),
        ("MARKOV", dict(scale=1, states="A", strategy="missrate"), "threshold"),
        ("MARKOV", dict(scale=1, states="A", strategy="entropy", threshold=1), "unknown strategy"),
    ],
)
def test_parameter_checks(algorithm, params, message):
    with pytest.raises(ValueError, match=message):
        detect_outliers(None, algorithm, **params)
