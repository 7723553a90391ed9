"""Plan properties: pushdown, pruning, no needless join, one fact scan, no Python worker."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from covlens.functions.members import filter_group
from covlens.operators.shares import lives_shares
from covlens.operators.summary import lives_summary
from covlens.plans.inspect import join_strategies, pushed_filters, read_schemas, scan_count, uses_python
from covlens.sources.fixtures import derive_hierarchy
from covlens.sources.readers import read_lives
from conftest import SMALL


def test_named_filter_reaches_the_scan(lives_small):
    df = lives_summary(lives_small, ["lives"], ["payer_category"], segments=["current_commercial"])
    pushed = " ".join(pushed_filters(df))
    assert "EqualTo(flag_current_record,Y)" in pushed and "EqualTo(book_of_business,Commercial)" in pushed


def test_derived_dimension_filter_becomes_null_test(lives_small):
    df = lives_summary(lives_small, ["lives"], ["benefit_type"], segments=["national_level"])
    assert "IsNull(ecosystem_code)" in " ".join(pushed_filters(df))


def test_or_group_is_pushed_whole(spark, lives_small):
    df = lives_summary(read_lives(spark, lives_small, where=filter_group("Y", "Medicare", how="or")), ["lives"], [])
    assert "Or(" in " ".join(pushed_filters(df))


def test_columns_are_pruned(lives_small):
    df = lives_summary(lives_small, ["lives"], ["payer_category"])
    schemas = read_schemas(df)
    assert schemas and all(s.count(":") == 3 for s in schemas)


def test_no_join_without_hierarchy_column(spark, lives_small):
    h = derive_hierarchy(spark, SMALL)
    df = lives_summary(lives_small, ["lives"], ["payer_category"], hierarchy=h)
    assert join_strategies(df) == []
    df2 = lives_summary(lives_small, ["lives"], ["base_name"], hierarchy=h)
    assert join_strategies(df2)


def test_denominators_read_only_grain_and_lives(lives_small):
    df = lives_shares(lives_small, ["pct_ecosystem_lives", "pct_national_lives"],
                      ["ecosystem_code", "benefit_type", "date_year_month", "payer_id"],
                      measures=["lives", "record_count", "pbm_rx_lives"])
    assert scan_count(df, executed=True) == 2
    schemas = sorted(read_schemas(df), key=len)
    grain = {"ecosystem_code", "benefit_type", "date_year_month", "rx_lives", "mx_lives"}
    assert set(re.findall(r"(\w+):", schemas[0])) == grain
    assert "payer_id" in schemas[1] and "pbm_rx_lives" in schemas[1]


def test_no_python_worker(spark, lives_small):
    from __spark_entry__ import queries

    for name in ["shares_all", "drill_geography", "quality_report", "prepare_current_flag", "trend_quarter"]:
        assert not uses_python(queries()[name](spark, SMALL)), name


def test_filter_before_window_stage(lives_small):
    df = lives_shares(lives_small, ["pct_ecosystem_lives"], ["ecosystem_code", "benefit_type", "date_year_month"],
                      where=F.col("payer_role") == "TPA", method="window")
    assert "EqualTo(payer_role,TPA)" in " ".join(pushed_filters(df))


def test_no_cross_join_nested_loop_or_python_anywhere(spark):
    from covlens.registry import QUERIES, load_all

    load_all()
    bad = {}
    for name, fn in sorted(QUERIES.items()):
        df = fn(spark, SMALL)
        joins = join_strategies(df)
        if any(j in ("BroadcastNestedLoopJoin", "CartesianProduct") for j in joins) or uses_python(df):
            bad[name] = joins
    assert not bad, bad


def test_stored_denominators_need_no_second_shuffle(spark, lives_small):
    dims = ["ecosystem_code", "benefit_type", "date_year_month", "zip", "plan_id"]
    shares = ["pct_ecosystem_lives", "pct_national_lives"]
    df = lives_shares(lives_small, shares, dims, method="stored")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    plain = lives_shares(lives_small, shares, dims)
    assert df.exceptAll(plain).count() == 0 and plain.exceptAll(df).count() == 0


def test_wide_request_is_shuffled_once_whatever_the_threshold(spark, lives_small):
    df_of = lambda method: lives_shares(
        lives_small, ["pct_ecosystem_lives", "pct_national_lives"],
        ["ecosystem_code", "benefit_type", "date_year_month", "zip", "plan_id"], method=method)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")  # smaller than any denominators
    try:
        df = df_of("join")
        rows = df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        other = df_of("window").collect()
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final
    assert len([x for x in final.split("\n") if "Exchange hashpartitioning" in x and "plan_id#" in x]) == 1
    assert sorted(map(repr, rows)) == sorted(map(repr, other))


def test_scale_settings():
    from covlens.plans.settings import scale_settings

    big = scale_settings(100 * (1 << 40), 4000)
    assert big["spark.sql.shuffle.partitions"] == "50000"
    mid = scale_settings(2 * (1 << 40), 4000)
    assert mid["spark.sql.shuffle.partitions"] == "8000"
    small = scale_settings(1 << 30, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert big["spark.sql.adaptive.coalescePartitions.parallelismFirst"] == "false"


def test_year_filter_prunes_folders(lives_small):
    from covlens.plans.inspect import partition_filters

    df = lives_summary(lives_small, ["lives"], ["payer_category"], where=F.col("date_year") >= "1997")
    assert any("date_year" in p for p in partition_filters(df))
