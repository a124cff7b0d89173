import pytest
from parity import connection, spark_rows, sql_rows

from chronomill.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, small, duck, name):
    assert spark_rows(QUERIES[name](spark, small)) == sql_rows(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
