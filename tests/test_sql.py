"""Every query with SQL against DuckDB at sf0.01, types included; the others give rows."""

import pytest

from aspectra.plans import catalog
from tests.oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same(spark, name):
    assert same(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
