"""Every registered query of the library against its SQL."""

import pytest
from oracle import check

from chronoloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    check(QUERIES[name](spark, sf), SQL[name], sf)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
