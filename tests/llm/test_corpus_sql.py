import pytest
from parity import connect, difference

from tomewright.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert difference(spark, connect(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == ""
