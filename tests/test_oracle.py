import pytest

from keyfold.queries import ORACLE_SQL, QUERIES

from compare import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, data, duck):
    same(QUERIES[name](spark, data), duck, ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
