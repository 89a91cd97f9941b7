"""Every registered query of the library against its DuckDB text."""

import pytest
from conftest import same_rows

from casesafety.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name not in registry.ORACLE_SQL:
        assert df.count() > 0
        return
    got = duck.execute(registry.ORACLE_SQL[name])
    ours, theirs = same_rows(df, got.fetchall(), [c[0] for c in got.description])
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
