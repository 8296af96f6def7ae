"""Every registered core query against its SQL, or, without SQL, for a stable schema and rows."""

import pytest

from siltweave.plans import catalog
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    if name in catalog.SQL:
        assert_same(df, catalog.SQL[name], data)
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
