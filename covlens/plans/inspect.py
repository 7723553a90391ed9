"""Reading physical plans: pushed filters, scans, joins, Python workers.

Uses the text that ``DataFrame.explain`` prints, so it works the same in any
session. ``executed=True`` runs the query first and reads AQE's final plan
(reused exchanges, joins converted to broadcast at run time).
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF",
                "FlatMapCoGroupsInPandas", "AggregateInPandas", "WindowInPandas")


def plan_text(df: DataFrame, mode: str = "formatted", executed: bool = False) -> str:
    if executed:
        df.collect()  # the DataFrame's own execution, so explain shows its final plan; small results only
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def pushed_filters(df: DataFrame) -> list[str]:
    """The PushedFilters lists of every Parquet scan in the plan."""
    return re.findall(r"PushedFilters: \[(.*)\]", plan_text(df, "formatted"))


def partition_filters(df: DataFrame) -> list[str]:
    """The PartitionFilters lists of every Parquet scan (folder pruning)."""
    return re.findall(r"PartitionFilters: \[(.*)\]", plan_text(df, "formatted"))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*?>)", plan_text(df, "formatted"))


def scan_count(df: DataFrame, executed: bool = False) -> int:
    """Parquet scans in the plan (in the final plan, reused exchanges are not scanned again)."""
    text = plan_text(df, "simple", executed)
    if executed:
        text = text.split("Final Plan ==", 1)[-1].split("== Initial Plan", 1)[0]
    return len(re.findall(r"FileScan parquet|Scan parquet", text))


def join_strategies(df: DataFrame, executed: bool = False) -> list[str]:
    text = plan_text(df, "simple", executed)
    if executed:
        text = text.split("Final Plan ==", 1)[-1].split("== Initial Plan", 1)[0]
    return re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)",
                      text)


def uses_python(df: DataFrame) -> bool:
    text = plan_text(df, "simple")
    return any(node in text for node in PYTHON_NODES)


def exchange_count(df: DataFrame) -> int:
    return len(re.findall(r"Exchange hashpartitioning|Exchange SinglePartition|Exchange rangepartitioning",
                          plan_text(df, "simple")))
