"""Every registered query against its DuckDB SQL on the driver tables (sf0.001)."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL
from covlens.registry import ORACLE, QUERIES, load_all
from oracle_compare import compare, duck

load_all()
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["payer_category", "lives"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    result = compare(spark, name, SMALL, con)
    assert result["ok"], result
