import pytest

import __spark_entry__ as entry
from tissuegrid.plans import registry
from tests.compare import connection, same


@pytest.fixture(scope="module")
def con(tables):
    return connection(tables)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(name, spark, tables, con):
    same(registry.QUERIES[name], registry.SQL[name], spark, tables, con)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(name, spark, tables):
    rows = registry.QUERIES[name](spark, tables).count()
    assert rows > 0 or name == "differential_genes"  # one region has a single cell in the smallest data


def test_entry(spark):
    assert entry.entry(spark).columns == ["cell", "gene", "value"]
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
