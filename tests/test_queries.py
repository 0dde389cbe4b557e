"""Every query of the catalog against its SQL on the smallest tables."""

import pytest

from scoreloom.plans import catalog, catalog_audit  # noqa: F401

from .compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLE_SQL:
        assert difference(df, con, catalog.ORACLE_SQL[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
