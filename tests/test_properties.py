"""Property tests on random small lives frames, against brute force in Python."""

from __future__ import annotations

from collections import defaultdict
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import lives_rows
from covlens.operators.rollup import build_rollup, lives_from_rollup
from covlens.operators.shares import lives_shares
from covlens.operators.summary import lives_summary
from covlens.session import fresh_path

ROW = st.fixed_dictionaries({
    "ecosystem_code": st.sampled_from([None, "E1", "E2"]),
    "benefit_type": st.sampled_from(["Pharmacy Benefit", "Medical Benefit"]),
    "date_year_month": st.sampled_from(["2026-01", "2026-02"]),
    "book_of_business": st.sampled_from(["Commercial", "Medicare"]),
    "flag_current_record": st.sampled_from(["Y", "N"]),
    "lives_source": st.sampled_from(["DRG Plan", "Payer-PBM"]),
    "payer_id": st.sampled_from(["P1", "P2", "P3"]),
    "rx_lives": st.one_of(st.none(), st.integers(0, 1000)),
    "mx_lives": st.one_of(st.none(), st.integers(0, 1000)),
    "pbm_rx_lives": st.one_of(st.none(), st.integers(0, 1000)),
})
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
GRAIN = ("ecosystem_code", "benefit_type", "date_year_month")


def lives_of(r):
    return r["rx_lives"] if r["rx_lives"] is not None else r["mx_lives"]


@SETTINGS
@given(st.lists(ROW, min_size=1, max_size=25))
def test_shares_match_brute_force(spark, rows):
    dims = [*GRAIN, "payer_id"]
    got = {tuple(r[d] for d in dims): r for r in lives_shares(
        lives_rows(spark, rows), ["pct_ecosystem_lives"], dims, include_hidden=True).collect()}
    window = {tuple(r[d] for d in dims): r for r in lives_shares(
        lives_rows(spark, rows), ["pct_ecosystem_lives"], dims, include_hidden=True, method="window").collect()}
    num, den = defaultdict(lambda: None), defaultdict(lambda: None)
    for r in rows:
        v = lives_of(r)
        if v is None:
            num.setdefault(tuple(r[d] for d in dims), None)
            continue
        k = tuple(r[d] for d in dims)
        num[k] = (num[k] or 0) + v
        g = tuple(r[d] for d in GRAIN)
        den[g] = (den[g] or 0) + v
    assert set(got) == {tuple(r[d] for d in dims) for r in rows} == set(window)
    for k, r in got.items():
        n, d = num.get(k), den.get(k[:3])
        assert r["lives"] == n and r["ecosystem_total_lives"] == d
        want = None if n is None or not d else Decimal(n) / Decimal(d)
        assert (r["pct_ecosystem_lives"] is None) == (want is None)
        if want is not None:
            assert abs(r["pct_ecosystem_lives"] - want) < Decimal("1e-18")
        assert window[k]["pct_ecosystem_lives"] == r["pct_ecosystem_lives"]


@SETTINGS
@given(st.lists(ROW, min_size=1, max_size=25),
       st.lists(st.sampled_from(["current_commercial", "ecosystem_level", "national_level", "plan_source",
                                 "pharmacy_benefit", "medical_benefit"]), max_size=2, unique=True))
def test_rollup_equals_fact(spark, rows, segments):
    df = lives_rows(spark, rows)
    path = fresh_path(spark, "prop-rollup")
    build_rollup(df, path)
    dims = ["payer_id", "geography_type"]
    served = lives_from_rollup(spark, path, None, ["lives", "pbm_rx_lives"], dims, segments=segments, on_miss="error")
    direct = lives_summary(df, ["lives", "pbm_rx_lives"], dims, segments=segments)
    assert served.exceptAll(direct).count() == 0 and direct.exceptAll(served).count() == 0


@SETTINGS
@given(st.lists(ROW, min_size=1, max_size=25))
def test_drill_levels_equal_group_bys(spark, rows):
    from pyspark.sql import functions as F

    from covlens.operators.hierarchy import drill

    df = lives_rows(spark, rows)
    levels = ["benefit_type", "ecosystem_code", "payer_id"]
    out = drill(df, levels, ["lives", "record_count"])
    n = len(levels)
    for depth in range(n + 1):
        gid = (1 << (n - depth)) - 1
        got = out.filter(F.col("grouping_id") == gid).select(*levels[:depth], "lives", "record_count")
        want = lives_summary(df, ["lives", "record_count"], levels[:depth])
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, depth
