"""Quality rules and preparation jobs on literal rows: each rule caught, each job's edge cases."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from conftest import lives_rows
from covlens.operators.prepare import apply_zip_lookup, union_feeds, with_calendar, with_load_time
from covlens.operators.quality import check_lives, lives_range_check

GOOD = {
    "benefit_type": "Pharmacy Benefit", "ecosystem_code": "ECO001", "payer_id": "P1", "payer_name": "Acme",
    "flag_current_record": "Y", "book_of_business": "Commercial", "zip": "94102", "date_id": "20260101",
    "date_year_month": "2026-01", "date_year_quarter": "2026-Q1", "date_year": "2026",
    "source_book_of_business": "Medicare", "payer_role": "TPA", "lives_source": "DRG Plan", "plan_id": "PL1",
    "plan_name": "Gold", "plan_type": "HMO", "mco_name": "Acme (MAC)", "state_code": "CA",
    "load_time": "2026-01-15T00:00:00Z", "rx_lives": 10,
}

BREAKS = {
    "benefit_type_valid": {"benefit_type": "Dental"},
    "flag_current_record_valid": {"flag_current_record": "X"},
    "book_of_business_valid": {"book_of_business": "Other"},
    "source_book_of_business_valid": {"source_book_of_business": "Other"},
    "payer_role_valid": {"payer_role": "BROKER"},
    "lives_source_valid": {"lives_source": "Survey"},
    "plan_type_valid": {"plan_type": "UNKNOWN"},
    "zip_format": {"zip": "9410"},
    "date_id_format": {"date_id": "20260115"},
    "date_year_month_format": {"date_year_month": "2026-13"},
    "date_year_quarter_format": {"date_year_quarter": "2026-Q5"},
    "date_year_format": {"date_year": "26"},
    "load_time_format": {"load_time": "2026-01-15 00:00"},
    "state_code_valid": {"state_code": "ZZ"},
    "payer_name_filled_current": {"payer_name": None, "mco_name": None},
    "plan_name_filled_current": {"plan_name": None},
    "lives_filled": {"rx_lives": None},
    "mco_name_composed": {"mco_name": "Other (MAC)"},
}


def test_every_rule_catches_its_break(spark):
    rows = [GOOD] + [{**GOOD, **change} for change in BREAKS.values()]
    report = {r["rule"]: r for r in check_lives(lives_rows(spark, rows)).collect()}
    for rule in BREAKS:
        assert report[rule]["failed"] >= 1, rule
    clean = {r["rule"]: r for r in check_lives(lives_rows(spark, [GOOD])).collect()}
    assert all(r["failed"] == 0 and r["passed"] for r in clean.values()), clean


def test_nullable_source_book_and_history_rows(spark):
    rows = [{**GOOD, "source_book_of_business": None}, {**GOOD, "flag_current_record": "N", "payer_name": None,
                                                          "mco_name": "Acme (MAC)"}]
    report = {r["rule"]: r for r in check_lives(lives_rows(spark, rows)).collect()}
    assert report["source_book_of_business_valid"]["failed"] == 0
    assert report["payer_name_filled_current"]["checked"] == 1
    assert report["payer_name_filled_current"]["failed"] == 0


def test_lives_threshold(spark):
    rows = [GOOD] * 19 + [{**GOOD, "rx_lives": None}]
    report = {r["rule"]: r for r in check_lives(lives_rows(spark, rows)).collect()}
    assert report["lives_filled"]["failed"] == 1 and report["lives_filled"]["passed"]
    rows = [GOOD] * 18 + [{**GOOD, "rx_lives": None}] * 2
    report = {r["rule"]: r for r in check_lives(lives_rows(spark, rows)).collect()}
    assert not report["lives_filled"]["passed"]


def test_range_check(spark):
    rows = [{**GOOD, "payer_id": "small", "rx_lives": 999}, {**GOOD, "payer_id": "ok", "rx_lives": 1000},
            {**GOOD, "payer_id": "big", "rx_lives": 50_000_001}, {**GOOD, "payer_id": "none", "rx_lives": None}]
    got = {r["payer_id"]: r["below"] for r in lives_range_check(lives_rows(spark, rows), ["payer_id"]).collect()}
    assert got == {"small": True, "big": False, "none": None}


def test_calendar_texts(spark):
    df = spark.createDataFrame([("2025-11-30",), ("2026-01-01",)], "d string").select(F.to_date("d").alias("d"))
    got = {r["date_id"]: r for r in with_calendar(df, "d").collect()}
    assert got["20251101"]["date_year_quarter"] == "2025-Q4" and got["20251101"]["date_year_month"] == "2025-11"
    assert got["20260101"]["date_year"] == "2026"


def test_zip_lookup_keeps_unmatched(spark):
    facts = spark.createDataFrame([("00001", "E"), ("99999", "E")], "zip string, ecosystem_code string")
    zips = spark.createDataFrame([("00001", "ECO001", "North", "CA")],
                                 "zip string, ecosystem_code string, ecosystem_name string, state_code string")
    got = {r["zip"]: r for r in apply_zip_lookup(facts, zips).collect()}
    assert got["00001"]["ecosystem_code"] == "ECO001" and got["99999"]["ecosystem_code"] is None


def test_load_time_and_feed_union(spark):
    stamped = with_load_time(spark.range(2)).collect()
    assert all(re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z", r["load_time"]) for r in stamped)
    plan = spark.createDataFrame([("a", 1)], "k string, rx_lives long")
    pbm = spark.createDataFrame([("b", 2)], "k string, pbm_rx_lives long")
    out = union_feeds({"DRG Plan": plan, "Payer-PBM": pbm})
    got = {r["k"]: r for r in out.collect()}
    assert got["a"]["lives_source"] == "DRG Plan" and got["a"]["pbm_rx_lives"] is None
    assert got["b"]["lives_source"] == "Payer-PBM" and got["b"]["rx_lives"] is None


def test_book_rules_join_once(spark, lives_small):
    from covlens.operators.prepare import apply_book_rules
    from covlens.plans.inspect import join_strategies

    rules = spark.createDataFrame(
        [(2, "Medicare", None, None, "A"), (1, None, "GOVERNMENT", None, "B"), (3, None, None, None, "C"), (1, None, "GOVERNMENT", None, "AA"), (0, "Medicare", "x", "y", "D")],
        "priority int, source_book_of_business string, payer_role string, plan_type string, book_of_business string",
    )
    rows = [("Medicare", "GOVERNMENT", "y"), ("Medicare", None, None), (None, "GOVERNMENT", None), (None, None, None), ("Medicare", "x", "y"), ("Medicare", "x", None)]
    df = spark.createDataFrame(rows, "source_book_of_business string, payer_role string, plan_type string")
    got = {tuple(r)[:3]: r["book_of_business"] for r in apply_book_rules(df, rules).collect()}
    assert got == dict(zip(rows, ["AA", "A", "AA", "C", "D", "A"]))
    assert {r["book_of_business"] for r in apply_book_rules(df, rules.filter("priority = 0")).collect()} == {"D", "Commercial"}
    assert len(join_strategies(apply_book_rules(df, rules))) == 2  # with the rules, and back to the rows
