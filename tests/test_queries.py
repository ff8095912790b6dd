import pytest

from tarnbeck.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(name, spark):
    compare(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
