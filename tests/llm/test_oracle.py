"""Training-data queries that SQL can express, against DuckDB on sf0.001."""

from __future__ import annotations

import pytest
from covlens.llm.queries import ORACLE, QUERIES
from oracle_compare import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    result = compare(spark, name, SMALL, duck(SMALL))
    assert result["ok"], result


def test_every_operator_has_a_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(QUERIES) <= set(names)
