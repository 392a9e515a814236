"""Registered queries that SQL can express, against DuckDB on the small tables."""

import pytest

from checks import compare
from spendlake.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_as_sql(spark, monkeypatch, name):
    monkeypatch.setattr(compare, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(compare, "ORACLES", queries.ORACLES)
    assert compare.differences(spark, compare.duck(SF_DIR), SF_DIR, name) is None
