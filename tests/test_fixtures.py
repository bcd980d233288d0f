"""Operators over small inputs, held against rows worked out by hand."""

import duckdb
import pytest

from tests import fixtures
from tests.test_registry import SF, rows_of


@pytest.mark.parametrize("name", list(fixtures.QUERIES))
def test_rows_worked_out_by_hand(spark, name):
    found = fixtures.QUERIES[name](spark, SF)
    said = duckdb.sql(fixtures.SQL[name])
    assert sorted(said.columns) == sorted(found.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(said.columns, said.fetchall())
