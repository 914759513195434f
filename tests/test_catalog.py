"""Each registered query of the library against its SQL, at the smallest size."""

import pytest

import cladewise.plans.catalog_more  # noqa: F401
from cladewise.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
