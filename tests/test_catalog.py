"""Every registered graph query against its SQL."""

import pytest
from parity import duck_rows, spark_rows

from quillgraph import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    columns, got = spark_rows(df)
    if name in catalog.ORACLE_SQL:
        assert (columns, got) == duck_rows(catalog.ORACLE_SQL[name], small)
    else:
        assert columns


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["a", "b", "shared"]
    assert set(e.oracle_sql()) <= set(e.queries())
