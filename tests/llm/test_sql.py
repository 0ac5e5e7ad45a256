"""The training-data queries that have DuckDB SQL give its rows."""

from __future__ import annotations

import pytest

from narrata.llm import queries
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    n, m, mine, theirs = compare(spark, queries.queries()[name], queries.oracle_sql()[name], SF)
    assert n == m and not mine and not theirs, (mine, theirs)
