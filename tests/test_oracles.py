"""Every registered query against its DuckDB SQL on the small tables; those without SQL must run."""

import pytest

from oracles import compare, connect
from trajspark import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL.get(name)) == ""
