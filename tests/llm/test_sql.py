"""Every query with SQL against DuckDB."""

import pytest

from aspectra.llm import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same(spark, name):
    assert same(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01") > 0
