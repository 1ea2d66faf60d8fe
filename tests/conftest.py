import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA


def comparable(frame):
    """Rows as sorted tuples of the columns in order of name; floats rounded, nulls and NaN alike."""
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x != x else round(float(x), 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(plain(x) for x in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, sf):
    """Checks a module's queries against its SQL, run by DuckDB on the same tables."""
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")

    def check(module, name):
        got, want = module.queries()[name](spark, sf).toPandas(), con.execute(module.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert comparable(got) == comparable(want)

    return check
