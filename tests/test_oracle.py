"""Each registered query against its SQL, on whole tables of the smallest set."""

import pytest
from check_oracle import compare, tables
from conftest import SF

from widemetrics import queries as registered


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_sql(spark, con, name):
    assert name in registered.oracle_sql()
    assert compare(spark, con, name, SF) == ""
