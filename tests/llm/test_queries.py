import pytest

from tests.compare import connection, same
from tissuegrid.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(tables):
    return connection(tables)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, tables, con):
    same(QUERIES[name], SQL[name], spark, tables, con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, tables):
    assert QUERIES[name](spark, tables).count() > 0


def test_every_problem_has_its_query():
    for n in (1, 2, 4, 5, 6, 8):
        assert f"p{n}_found" in QUERIES
    assert any(q.startswith("p7_") for q in QUERIES) and any(q.startswith("p9_") for q in QUERIES)
