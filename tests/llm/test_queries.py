import pytest
from compare import same

from keyfold.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, data, duck):
    same(QUERIES[name](spark, data), duck, ORACLE_SQL[name])
