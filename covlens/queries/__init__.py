"""Registered queries, grouped by the part of the model they exercise."""

from . import (  # noqa: F401
    hierarchy_queries,
    prepare_queries,
    quality_queries,
    rollup_queries,
    share_queries,
    summary_queries,
    trend_queries,
)
