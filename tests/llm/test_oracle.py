"""The same for the queries of this subpackage."""

from __future__ import annotations

import pytest

from quaystone.llm import queries
from tests.test_oracle import duck, empty_tables, pytestmark, same  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_duckdb(spark, duck, name):  # noqa: F811
    same(spark, duck, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_tables, name):  # noqa: F811
    assert queries.QUERIES[name](spark, empty_tables).count() == 0
