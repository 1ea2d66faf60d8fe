"""Every query that SQL can express, against DuckDB on the same tables."""

import pytest

from tidemark.plans import queries_catalog, queries_reference, queries_series

CASES = [(m, n) for m in (queries_reference, queries_catalog, queries_series) for n in m.oracle_sql()]


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_same_as_sql(same_as_sql, module, name):
    same_as_sql(module, name)


def test_every_sql_has_its_query():
    for m in (queries_reference, queries_catalog, queries_series):
        assert set(m.oracle_sql()) <= set(m.queries())


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
