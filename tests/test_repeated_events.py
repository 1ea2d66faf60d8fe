"""Events that come several times at one time: each is a point, as in SQL."""

import pytest

from tidemark.plans import queries_catalog, queries_reference

CASES = [
    (queries_catalog, "catalog_aggregate"),
    (queries_catalog, "catalog_many"),
    (queries_catalog, "catalog_repair"),
    (queries_reference, "stream_rollup"),
    (queries_catalog, "catalog_counts"),
    (queries_catalog, "catalog_meta"),
    (queries_catalog, "catalog_retrieve"),
    (queries_catalog, "catalog_flex"),
    (queries_catalog, "catalog_names"),
    (queries_catalog, "catalog_rows"),
]


@pytest.fixture(scope="module")
def repeated(spark, sf, tmp_path_factory):
    """A folder whose events are all there three times, under other keys."""
    at = str(tmp_path_factory.mktemp("repeated"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    copies = events.crossJoin(spark.range(3).withColumnRenamed("id", "k")).selectExpr("event_id + k * 1000 AS event_id", "ts", "user_id + k * 15 AS user_id", "event_type", "value", "props")
    copies.write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_same_as_sql_on_repeated_events(spark, repeated, module, name):
    import duckdb
    from conftest import comparable

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{repeated}/events.parquet/*.parquet'")
    got, want = module.queries()[name](spark, repeated).toPandas(), con.execute(module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


GONE = [
    ("catalog_many", "/levels"),
    ("catalog_counts", "/raw"),
    ("catalog_meta", ""),
    ("catalog_retrieve", "/raw/metric=ev.view"),
    ("catalog_flex", "/levels"),
    ("catalog_names", "/meta"),
    ("catalog_rows", "/levels/interval=3600000000000"),
]


@pytest.mark.parametrize(("name", "part"), GONE, ids=[n for n, _ in GONE])
def test_catalog_deleted_since_is_made_again(same_as_sql, spark, sf, name, part):
    """What has gone from the shared folder since the catalog was made isn't read as empty."""
    import shutil

    shutil.rmtree(queries_catalog._catalog(spark, sf).path.removeprefix("file://") + part)
    same_as_sql(queries_catalog, name)


def test_aggregate_to_a_repeated_last_point(spark):
    """No point of the last time counts, and the least value of a time takes the stretch before it."""
    from tidemark.model import RAW
    from tidemark.operators.aggregate import aggregate

    rows = spark.createDataFrame([("m", t, v) for t, v in ((10, 1.0), (20, 3.0), (20, 2.0), (30, 5.0), (30, 5.0))], RAW)
    assert [tuple(r) for r in aggregate(rows, 5, 40).collect()] == [("m", 1.0, 5.0, 6.0, 3, 70.0, 20)]


def test_repeated_times_only_where_asked_for(spark, tmp_path):
    from tidemark.errors import OutOfOrder
    from tidemark.model import RAW
    from tidemark.sources.catalog import Catalog

    cat = Catalog.from_config(spark, {"type": "file", "path": f"file://{tmp_path}/db", "metrics": {"m": {"interval_min": 10, "interval_max": 100, "interval_factor": 10}}})
    rows = lambda *ts: spark.createDataFrame([("m", t, 1.0) for t in ts], RAW)
    cat.insert(rows(5, 5, 23), repeated=True)
    for bad, repeated in ((rows(30, 30), False), (rows(23, 30), True), (rows(30, None), True)):
        with pytest.raises(OutOfOrder):
            cat.insert(bad, repeated)
    assert cat["m"].count() == 3 and sorted((r.t, r.c, r.a) for r in cat["m"].levels().collect()) == [(0, 2, 5), (10, 0, 10)]


def test_stream_takes_a_repeated_time_in_one_batch_only(spark, tmp_path):
    from tidemark.config import RollupConfig
    from tidemark.model import RAW
    from tidemark.streaming.rollup import late_points, level_rows, stream_levels

    for part in ([5, 5, 23], [23, 31, 31, 45]):
        spark.createDataFrame([("m", t, 1.0) for t in part], RAW).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(RAW).parquet(f"{tmp_path}/in")
        stream_levels(s, RollupConfig(10, 100, 10), "mark", repeated=True).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.t, r.c) for r in level_rows(out).collect()) == [(0, 2), (10, 0), (20, 1), (30, 2)]
    assert [r.t for r in late_points(out).collect()] == [23]
