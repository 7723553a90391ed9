"""Semi-additive totals and gapless periods on literal rows."""

from __future__ import annotations

from covlens.operators.trends import lives_snapshot, trend

from conftest import lives_rows


def _lives(spark, rows):
    """(payer, month, lives) rows with the calendar's other texts."""
    full = []
    for payer, month, n in rows:
        q = month and f"{month[:4]}-Q{(int(month[5:]) + 2) // 3}"
        full.append({"payer_id": payer, "date_year_month": month, "date_year_quarter": q, "date_year": month and month[:4], "rx_lives": n})
    return lives_rows(spark, full)


ROWS = [
    ("a", "2023-11", 5), ("a", "2023-12", 7), ("a", "2024-01", 8), ("a", "2024-02", 9), ("a", "2024-08", 4), ("a", "2024-08", 6),
    ("b", "2024-01", 3), ("b", "2024-03", None), (None, "2024-05", 1), ("c", None, 2), ("c", "2024-02", 1),
]


def test_snapshot_takes_the_last_month_of_each_group(spark):
    got = {(r["payer_id"], r["date_year_quarter"]): (r["as_of_month"], r["lives"]) for r in lives_snapshot(_lives(spark, ROWS), ["lives"], ["payer_id"]).collect()}
    assert got == {
        ("a", "2023-Q4"): ("2023-12", 7), ("a", "2024-Q1"): ("2024-02", 9), ("a", "2024-Q3"): ("2024-08", 10),
        ("b", "2024-Q1"): ("2024-03", None), (None, "2024-Q2"): ("2024-05", 1), ("c", None): (None, 2), ("c", "2024-Q1"): ("2024-02", 1),
    }


def test_snapshot_never_adds_months(spark):
    year = {r["payer_id"]: r["lives"] for r in trend(_lives(spark, ROWS), "year", by=["payer_id"], snapshot=True).filter("date_year = '2024'").collect()}
    assert year["a"] == 10  # added up it would be 27
    change = {(r["payer_id"], r["date_year"]): r["change"] for r in trend(_lives(spark, ROWS), "year", by=["payer_id"], snapshot=True).collect()}
    assert change["a", "2024"] == 3


def test_complete_months(spark):
    got = trend(_lives(spark, ROWS), "month", by=["payer_id"], complete=True).collect()
    a = sorted((r["date_year_month"], r["lives"], r["previous_lives"]) for r in got if r["payer_id"] == "a")
    assert [m for m, _, _ in a] == ["2023-11", "2023-12", *(f"2024-{m:02}" for m in range(1, 9))]
    assert a[3] == ("2024-02", 9, 8) and a[4] == ("2024-03", None, 9) and a[5] == ("2024-04", None, None) and a[9] == ("2024-08", 10, None)
    assert sorted((r["date_year_month"], r["lives"]) for r in got if r["payer_id"] == "b") == [("2024-01", 3), ("2024-02", None), ("2024-03", None)]
    assert [r["date_year_month"] for r in got if r["payer_id"] is None] == ["2024-05"]
    assert {r["date_year_month"] for r in got if r["payer_id"] == "c"} == {None, "2024-02"}


def test_complete_quarters_and_years(spark):
    got = trend(_lives(spark, ROWS), "quarter", by=["payer_id"], complete=True, snapshot=True).collect()
    assert sorted(r["date_year_quarter"] for r in got if r["payer_id"] == "a") == ["2023-Q4", "2024-Q1", "2024-Q2", "2024-Q3"]
    years = [("a", "2020-01", 1), ("a", "2023-06", 2)]
    got = trend(_lives(spark, years), "year", complete=True).collect()
    assert sorted((r["date_year"], r["lives"]) for r in got) == [("2020", 1), ("2021", None), ("2022", None), ("2023", 2)]
