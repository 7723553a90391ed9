"""Write PLANS.md: the executed (AQE final) plans of key registered queries.

Run: ``python tests/plan_report.py [sf_dir] > PLANS.md``. For each query it
records scans, shuffles, reused exchanges, join strategies and pushed filters,
then the final physical plan.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

KEY_QUERIES = [
    "lives_by_payer_category_current_commercial",
    "filter_group_or",
    "caller_filter",
    "segment_national",
    "share_of_ecosystem",
    "shares_all",
    "share_grand_total",
    "hierarchy_join",
    "drill_geography",
    "rollup_serve",
    "quality_report",
    "prepare_current_flag",
    "prepare_changes",
    "trend_quarter",
]


SCALE_NOTES = """## Reading these plans at 100 TB

- Additive requests: one scan with the named filters in `PushedFilters`, year filters in
  `PartitionFilters` (the stored fact has one folder per year), and only the used columns in
  `ReadSchema`; partial aggregation before the one shuffle. The shuffle carries at most one row per group
  per task, so a key holding a third of the rows costs one row per task.
- Shares: the request's aggregation (one shuffle, as above), plus a second scan that reads only the grain
  and lives columns. That scan is combined map-side, so its shuffle is bounded by the number of grain
  values (ecosystems x benefit types x books x months). The coarser denominators are windows over that
  small frame. The denominator frame meets the request in a broadcast hash join, which AQE picks from its
  measured size; beyond the threshold it is a shuffled join with skew splitting.
- Hierarchy: the fact is summed to the request's keys plus the join keys before the join. The hierarchy
  side is broadcast only when its measured size allows.
- Drills: one scan and one shuffle; the rollup's Expand runs map-side before partial aggregation.
- Current-record flag: an aggregation and a join whose sides are both shuffle stages, so AQE can split a
  hot group (`tests/test_skew.py` shows `skew=true`). A window over the group would sort it in one task.
- Change detection: one grouping of (key, 8-byte hash, side, order) instead of a full outer join.
- Trends: one scan; `lag` over the aggregated frame, one row per period per partition.
"""


def final_plan(text: str) -> str:
    body = text.split("+- == Final Plan ==", 1)[-1].split("+- == Initial Plan ==", 1)[0]
    lines = []
    for line in body.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "Location: ...", line)
        lines.append(line[:180])
    return "\n".join(line for line in lines if line.strip())


def main(argv):
    from covlens.plans.inspect import partition_filters, plan_text, pushed_filters
    from covlens.session import local_session
    from __spark_entry__ import queries

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, shuffle_partitions=16)
    registry = queries()
    print("# Executed plans of key queries\n")
    print(f"Generated by `tests/plan_report.py` at `{sf_dir}` on local[8], AQE on; final plans after execution.")
    print("Expression ids, plan ids and file locations are elided.\n")
    print(SCALE_NOTES)
    for name in KEY_QUERIES:
        df = registry[name](spark, sf_dir)
        text = plan_text(df, "simple", executed=True)
        plan = final_plan(text)
        scans = len(re.findall(r"FileScan parquet", plan))
        shuffles = len(re.findall(r"Exchange hashpartitioning|Exchange SinglePartition|Exchange RoundRobin", plan))
        reused = len(re.findall(r"ReusedExchange", plan))
        joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)", plan)
        pushed = [p for p in pushed_filters(df) if p]
        pruned = [re.sub(r"#\d+", "", p) for p in partition_filters(df) if p]
        print(f"## {name}\n")
        print(f"- parquet scans: {scans}, shuffles: {shuffles}, reused exchanges: {reused}")
        print(f"- joins: {', '.join(joins) if joins else 'none'}")
        print(f"- pushed filters: {'; '.join(pushed) if pushed else 'none'}")
        print(f"- partition filters: {'; '.join(pruned) if pruned else 'none'}\n")
        print("```")
        print(plan)
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
