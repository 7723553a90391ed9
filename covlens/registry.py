"""Registered queries: one callable per operator, each (spark, sf_dir) -> DataFrame.

Every query reads the driver tables, or the coverage tables Spark derives
from them, over whole tables. Each is registered with its DuckDB SQL (see
``covlens.oracle``); computed columns carry the same names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is its SQL over the coverage tables (None: no SQL form)."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = with_tables(oracle)
        return fn

    return wrap


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries  # noqa: F401
