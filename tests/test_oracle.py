"""Every registered query against DuckDB on the small tables."""

import pytest

from checks.compare import differences, duck
from checks.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, connection, name):
    assert differences(spark, connection, SF_DIR, name) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["currency", "total"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
