"""Every core query against its SQL, and the driver's contract."""

import pytest
from oracle import connection, rows_of, sql_rows

import __spark_entry__ as entry
from strandline import catalog


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, data, con, name):
    assert rows_of(catalog.queries()[name](spark, data)) == sql_rows(con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_contract(spark, data):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
