"""Literal-row cases the driver tables cannot supply (FIXTURES.md section 3) and the grain rules."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import lives_rows
from covlens.operators.hierarchy import check_many_to_one, drill, with_hierarchy
from covlens.operators.quality import key_check
from covlens.operators.shares import lives_shares
from covlens.operators.summary import lives_summary

BASE = {
    "benefit_type": "Pharmacy Benefit", "date_year_month": "2026-01", "book_of_business": "Commercial",
    "flag_current_record": "Y", "lives_source": "DRG Plan", "payer_id": "P1", "plan_id": "PL1",
}


def row(**kw):
    out = dict(BASE)
    out.update(kw)
    return out


def test_zero_denominator_gives_null_share(spark):
    df = lives_rows(spark, [row(ecosystem_code="E1", rx_lives=0), row(ecosystem_code="E1", payer_id="P2", rx_lives=0)])
    out = lives_shares(df, ["pct_ecosystem_lives"], ["ecosystem_code", "benefit_type", "date_year_month", "payer_id"])
    got = out.collect()
    assert len(got) == 2 and all(r["pct_ecosystem_lives"] is None for r in got)


def test_all_null_group(spark):
    df = lives_rows(spark, [row(ecosystem_code="E1"), row(ecosystem_code="E2", rx_lives=5)])
    out = lives_shares(df, ["pct_national_lives"], ["ecosystem_code", "benefit_type", "date_year_month"],
                       include_hidden=True)
    got = {r["ecosystem_code"]: r for r in out.collect()}
    assert got["E1"]["lives"] is None and got["E1"]["pct_national_lives"] is None
    assert got["E2"]["pct_national_lives"] == Decimal(1)
    assert got["E1"]["national_total_lives"] == 5


def test_sum_of_nothing_is_null_and_count_zero(spark):
    df = lives_rows(spark, [row()]).filter(F.lit(False))
    got = lives_summary(df, ["lives", "record_count"], []).collect()[0]
    assert got["lives"] is None and got["record_count"] == 0


def test_large_value_fits_and_overflow_raises(spark):
    ok = lives_rows(spark, [row(ecosystem_code="E1", rx_lives=999_999_999_999_999_999)])
    got = lives_shares(ok, ["pct_ecosystem_lives"], ["ecosystem_code", "benefit_type", "date_year_month"]).collect()
    assert got[0]["pct_ecosystem_lives"] == Decimal(1)
    bad = lives_rows(spark, [row(ecosystem_code="E1", rx_lives=10**18)])
    with pytest.raises(Exception):
        lives_shares(bad, ["pct_ecosystem_lives"], ["ecosystem_code", "benefit_type", "date_year_month"]).collect()


def test_half_way_share_rounds_up(spark):
    rows = [row(ecosystem_code="E1", payer_id="P1", rx_lives=1), row(ecosystem_code="E1", payer_id="P2", rx_lives=127)]
    out = lives_shares(lives_rows(spark, rows), ["pct_ecosystem_lives"],
                       ["ecosystem_code", "benefit_type", "date_year_month", "payer_id"])
    got = {r["payer_id"]: r["pct_ecosystem_lives"] for r in out.collect()}
    assert got["P1"] == Decimal(1) / Decimal(128)
    assert out.schema["pct_ecosystem_lives"].dataType.simpleString() == "decimal(38,20)"
    shown = out.select("payer_id", F.round("pct_ecosystem_lives", 6).cast("double").alias("s")).collect()
    assert {r["payer_id"]: r["s"] for r in shown}["P1"] == 0.007813


def test_small_share_keeps_digits(spark):
    rows = [row(ecosystem_code="E1", payer_id="P1", rx_lives=1),
            row(ecosystem_code="E1", payer_id="P2", rx_lives=29_999_999)]
    out = lives_shares(lives_rows(spark, rows), ["pct_ecosystem_lives"],
                       ["ecosystem_code", "benefit_type", "date_year_month", "payer_id"])
    got = {r["payer_id"]: r["pct_ecosystem_lives"] for r in out.collect()}
    assert got["P1"] > 0 and abs(float(got["P1"]) - 1 / 30_000_000) < 1e-15


def test_null_ecosystem_is_its_own_denominator_group(spark):
    rows = [row(ecosystem_code=None, payer_id="P1", rx_lives=3), row(ecosystem_code=None, payer_id="P2", rx_lives=1),
            row(ecosystem_code="E1", payer_id="P1", rx_lives=10)]
    for method in ("join", "window"):
        out = lives_shares(lives_rows(spark, rows), ["pct_ecosystem_lives"],
                           ["ecosystem_code", "benefit_type", "date_year_month", "payer_id"], include_hidden=True,
                           method=method)
        got = {(r["ecosystem_code"], r["payer_id"]): r for r in out.collect()}
        assert got[(None, "P1")]["ecosystem_total_lives"] == 4
        assert got[(None, "P1")]["pct_ecosystem_lives"] == Decimal("0.75")
        assert got[("E1", "P1")]["pct_ecosystem_lives"] == Decimal(1)


def test_partial_grain_and_strict(spark):
    rows = [row(ecosystem_code="E1", date_year_month="2026-01", rx_lives=1),
            row(ecosystem_code="E1", date_year_month="2026-02", rx_lives=3),
            row(ecosystem_code="E2", date_year_month="2026-01", rx_lives=4)]
    df = lives_rows(spark, rows)
    out = lives_shares(df, ["pct_ecosystem_lives"], ["ecosystem_code", "benefit_type"], include_hidden=True)
    got = {r["ecosystem_code"]: r["ecosystem_total_lives"] for r in out.collect()}
    assert got == {"E1": 4, "E2": 4}
    with pytest.raises(ValueError):
        lives_shares(df, ["pct_ecosystem_lives"], ["ecosystem_code", "benefit_type"], strict=True)


def test_empty_grain_divides_by_total(spark):
    rows = [row(payer_role="A", rx_lives=1), row(payer_role="B", rx_lives=3)]
    out = lives_shares(lives_rows(spark, rows), ["pct_national_lives"], ["payer_role"])
    got = {r["payer_role"]: r["pct_national_lives"] for r in out.collect()}
    assert got == {"A": Decimal("0.25"), "B": Decimal("0.75")}


def test_filters_reach_denominators(spark):
    rows = [row(ecosystem_code="E1", payer_id="P1", rx_lives=1),
            row(ecosystem_code="E1", payer_id="P2", rx_lives=3, flag_current_record="N")]
    out = lives_shares(lives_rows(spark, rows), ["pct_ecosystem_lives"],
                       ["ecosystem_code", "benefit_type", "date_year_month", "payer_id"],
                       segments=["current_commercial"], include_hidden=True)
    got = out.collect()
    assert len(got) == 1 and got[0]["ecosystem_total_lives"] == 1


def test_targets_are_exact(spark):
    rows = [row(ecosystem_code="E1", payer_id="P1", rx_lives=1), row(ecosystem_code="E1", payer_id="P2", rx_lives=4)]
    out = lives_shares(lives_rows(spark, rows), ["pct_ecosystem_lives"],
                       ["ecosystem_code", "benefit_type", "date_year_month", "payer_id"],
                       targets={"pct_ecosystem_lives": 0.2})
    got = {r["payer_id"]: r["meets_pct_ecosystem_lives"] for r in out.collect()}
    assert got == {"P1": True, "P2": True}


def test_pharmacy_lives_fall_back_to_medical(spark):
    rows = [row(rx_lives=5, mx_lives=100), row(rx_lives=None, mx_lives=7), row(rx_lives=None, mx_lives=None)]
    got = lives_summary(lives_rows(spark, rows), ["lives", "rx_lives", "mx_lives", "record_count"]).collect()[0]
    assert (got["lives"], got["rx_lives"], got["mx_lives"], got["record_count"]) == (12, 5, 107, 3)


def test_duplicate_hierarchy_key_fails_before_join(spark):
    hierarchy = spark.createDataFrame([("X", "a"), ("X", "b")], "base_mdm_id string, base_name string")
    with pytest.raises(ValueError):
        check_many_to_one(hierarchy)
    joined = with_hierarchy(lives_rows(spark, [row(payer_id="X", plan_id="X")]), hierarchy)
    with pytest.raises(Exception, match="hierarchy key base_mdm_id is not unique: X"):
        joined.collect()
    with pytest.raises(Exception, match="is not unique"):
        lives_summary(lives_rows(spark, [row(payer_id="X", plan_id="X")]), ["lives"], ["base_name"], hierarchy=hierarchy).collect()


def test_hierarchy_join_keeps_every_fact_row(spark):
    hierarchy = spark.createDataFrame([("P1", "one")], "base_mdm_id string, base_name string")
    rows = [row(payer_id="P1", plan_id="P1"), row(payer_id="P1", plan_id="Q"), row(payer_id="Z", plan_id="P1")]
    joined = with_hierarchy(lives_rows(spark, rows), hierarchy)
    assert joined.count() == 3
    assert joined.filter(F.col("base_name").isNotNull()).count() == 1
    assert with_hierarchy(lives_rows(spark, rows), hierarchy, match="plan").filter("base_name IS NOT NULL").count() == 2


def test_null_in_key_is_a_duplicate(spark):
    rows = [row(ecosystem_code=None, zip="00001", date_id="20260101"),
            row(ecosystem_code=None, zip="00001", date_id="20260101")]
    got = key_check(lives_rows(spark, rows)).collect()[0]
    assert (got["keys"], got["repeated_keys"], got["rows_in_repeats"]) == (1, 1, 2)


def test_real_null_versus_subtotal(spark):
    rows = [row(ecosystem_code=None, ecosystem_name=None, commercial_region_name="West", rx_lives=2),
            row(ecosystem_code="E1", ecosystem_name="East", commercial_region_name="West", rx_lives=3)]
    out = drill(lives_rows(spark, rows), ["commercial_region_name", "ecosystem_name"])
    got = {(r["commercial_region_name"], r["ecosystem_name"], r["grouping_id"]): (r["lives"], r["drill_level"])
           for r in out.collect()}
    assert got[("West", None, 0)] == (2, "ecosystem_name")
    assert got[("West", None, 1)] == (5, "commercial_region_name")
    assert got[(None, None, 3)] == (5, "total")


def test_unknown_members_raise(spark):
    df = lives_rows(spark, [row()])
    with pytest.raises(KeyError):
        lives_summary(df, ["nope"], [])
    with pytest.raises(KeyError):
        lives_summary(df, ["lives"], ["nope"])
    with pytest.raises(KeyError):
        lives_summary(df, ["lives"], [], segments=["nope"])


def test_change_kinds_and_repeated_key(spark):
    from covlens.operators.prepare import detect_changes

    schema = "k string, v string, t string"
    prev = spark.createDataFrame([("a", "1", "t1"), ("b", "1", "t1"), ("c", "1", "t1"), ("d", None, "t1")], schema)
    cur = spark.createDataFrame(
        [("a", "1", "t2"), ("b", "2", "t2"), ("e", "1", "t2"), ("d", None, "t2"),
         ("c", "1", "t1"), ("c", "9", "t3")],  # c repeats: the newest row (t3) counts
        schema,
    )
    got = {r["k"]: r["change"] for r in detect_changes(prev, cur, "k", ["v"], newest_by=["t"]).collect()}
    assert got == {"a": "same", "b": "update", "c": "update", "d": "same", "e": "insert"}
    gone = {r["k"]: r["change"] for r in detect_changes(cur, prev, "k", ["v"], newest_by=["t"]).collect()}
    assert gone["e"] == "delete"


def test_content_hash_tells_null_positions_apart(spark):
    from covlens.operators.prepare import content_hash

    df = spark.createDataFrame([("x", None), (None, "x")], "a string, b string")
    hashes = [r[0] for r in df.select(content_hash(["a", "b"])).collect()]
    assert hashes[0] != hashes[1]


def test_row_hash_is_unambiguous(spark):
    from covlens.operators.prepare import row_hash

    df = spark.createDataFrame(
        [("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x"), ('a","b', "c"), ("a", '","b", "c')],
        "p string, q string",
    )
    hashes = [r[0] for r in df.select(row_hash(["p", "q"])).collect()]
    assert len(set(hashes)) == len(hashes)


def test_zips_beyond_100000_customers_do_not_multiply_rows(spark, tmp_path):
    """Customer keys of six digits share zips; the zip table still has one row per zip."""
    from covlens.operators.prepare import apply_zip_lookup
    from covlens.sources.fixtures import derive_zip_table, zip_of

    n = 150_000
    spark.range(1, n + 1).selectExpr("id as c_custkey", "id % 25 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(25).selectExpr("id as n_nationkey", "concat('N', id) as n_name", "id % 5 as n_regionkey").write.parquet(
        f"{tmp_path}/nation.parquet")
    zips = derive_zip_table(spark, str(tmp_path))
    assert zips.count() == 100_000 and zips.select("zip").distinct().count() == 100_000
    lives = spark.range(1, n + 1).select(zip_of(F.col("id")).alias("zip"))
    out = apply_zip_lookup(lives, zips)
    assert out.count() == n and out.filter("state_code is null").count() == 0


def test_zip_lookup_refuses_a_repeated_zip(spark):
    from covlens.operators.prepare import apply_zip_lookup

    zips = spark.createDataFrame([("1", "E", "N", "CA"), ("1", "F", "M", "NY"), ("2", "G", "O", "TX")],
                                 "zip string, ecosystem_code string, ecosystem_name string, state_code string")
    lives = spark.createDataFrame([("1",), ("2",), (None,)], "zip string")
    with pytest.raises(Exception, match="zip table is not unique: 1"):
        apply_zip_lookup(lives, zips).collect()
    assert apply_zip_lookup(lives, zips.filter("zip = '2'")).filter("state_code = 'TX'").count() == 1


def test_many_book_rules_and_no_job_while_planning(spark):
    from covlens.operators.prepare import apply_book_rules

    schema = "priority int, source_book_of_business string, payer_role string, plan_type string, book_of_business string"
    rules = [(i, f"S{i}", None, None, f"B{i}") for i in range(20_000)] + [(20_001, None, "R", None, "by role"), (5, "S7", "R", None, "both")]
    rows = [("S7", "R", None), ("S7", None, "HMO"), ("S19999", "R", None), ("none", "R", "HMO"), ("none", "X", None), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "source_book_of_business string, payer_role string, plan_type string")
    spark.sparkContext.setJobGroup("book-rules", "planning")
    out = apply_book_rules(df, spark.createDataFrame(rules, schema))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("book-rules")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = sorted(((r[0], r[1], r[2], r["book_of_business"]) for r in out.collect()), key=str)
    assert got == sorted([("S7", "R", None, "both"), ("S7", None, "HMO", "B7"), ("S19999", "R", None, "B19999"), ("none", "R", "HMO", "by role"),
                          ("none", "X", None, "Commercial"), (None, None, None, "Commercial"), (None, None, None, "Commercial")], key=str)
    assert apply_book_rules(df, spark.createDataFrame([], schema)).filter("book_of_business = 'Commercial'").count() == 7


def test_ties_give_the_same_row_again(spark):
    from covlens.operators.prepare import dedup, detect_changes

    rows = [("k", str(i), "t") for i in range(50)]
    schema = "k string, v string, t string"
    first = dedup(spark.createDataFrame(rows, schema).repartition(7), "k", ["t"]).collect()
    again = dedup(spark.createDataFrame(rows[::-1], schema).repartition(3), "k", ["t"]).collect()
    assert len(first) == 1 and first == again
    one, two = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema).repartition(5)
    assert detect_changes(one, two, "k", ["v"], newest_by=["t"]).collect()[0]["change"] == "same"


def test_impossible_load_time_fails(spark):
    from covlens.operators.quality import check_lives

    rows = [row(load_time="2026-02-31T00:00:00Z"), row(load_time="2026-02-28T00:00:00Z")]
    report = {r["rule"]: r for r in check_lives(lives_rows(spark, rows)).collect()}
    assert report["load_time_format"]["failed"] == 0 and report["load_time_is_time"]["failed"] == 1


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from covlens.session import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)
