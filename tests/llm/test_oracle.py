import pytest
from oracle import compare, connect

from larkspur.llm.queries import ORACLE, QUERIES

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    compare(QUERIES[name](spark, f"/root/testdata/{SF}"), ORACLE[name], connect(SF))
