import pytest
from oracle import compare, connect

from larkspur.plans.queries import ORACLE, QUERIES

SF = "sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    compare(QUERIES[name](spark, f"/root/testdata/{SF}"), ORACLE[name], con)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
