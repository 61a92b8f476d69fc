"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import pytest

from lodestrata import catalog
from tests.oracle_check import same, tables


@pytest.fixture(scope="module")
def connection(data):
    return tables(data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, data, connection, name):
    same(catalog.queries()[name](spark, data), catalog.oracle_sql()[name], connection)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["question_id", "record_id", "chunk_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
