"""Shares of ecosystem and nation (M1-M4, R1-R5) under the grain rules D1, D4, D5, D7, D8.

Shares are shown rounded half-up to six places as DOUBLE, the form both
engines can state exactly; the library returns DECIMAL(38,20).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.shares import DENOMINATORS, SHARES, TARGETS, lives_shares
from ..oracle import GEO_TYPE, LIVES_SUM, share_sql
from ..registry import register
from ..sources.fixtures import lives_table


def shown(df, shares):
    """Shares rounded to six places as DOUBLE, for display and comparison."""
    return df.select(*[F.round(F.col(c), 6).cast("double").alias(c) if c in shares else F.col(c) for c in df.columns])


def _dim_sql(d: str) -> str:
    return f"{GEO_TYPE} AS geography_type" if d == "geography_type" else d


def share_oracle(dims, shares, where=None, hidden=False, targets=False, measures=("lives",)) -> str:
    """DuckDB form: aggregate, then window sums at the effective grain."""
    den_names = list(dict.fromkeys(SHARES[s] for s in shares))
    dims_sql = ", ".join(_dim_sql(d) for d in dims)
    group = ", ".join(str(i + 1) for i in range(len(dims)))
    extra = ""
    if "record_count" in measures:
        extra = ", count(*) AS record_count"
    inner = f"SELECT {dims_sql}{', ' if dims else ''}{LIVES_SUM} AS lives{extra} FROM lives"
    if where:
        inner += f" WHERE {where}"
    if dims:
        inner += f" GROUP BY {group}"
    dens = []
    for d in den_names:
        grain = [c for c in DENOMINATORS[d] if c in dims]
        part = f"PARTITION BY {', '.join(grain)}" if grain else ""
        dens.append(f"sum(lives) OVER ({part}) AS {d}")
    cols = list(dims) + list(dict.fromkeys(["lives", *measures]))
    if hidden:
        cols += [f"CAST({d} AS BIGINT) AS {d}" for d in den_names]
    cols += [f"{share_sql('lives', SHARES[s])} AS {s}" for s in shares]
    if targets:
        for s in shares:
            k = round(1 / TARGETS[s])
            cols.append(
                f"CASE WHEN lives IS NULL OR nullif({SHARES[s]}, 0) IS NULL THEN NULL "
                f"ELSE {k} * lives >= {SHARES[s]} END AS meets_{s}"
            )
    return f"WITH a AS ({inner}), d AS (SELECT *, {', '.join(dens)} FROM a) SELECT {', '.join(cols)} FROM d"


def share_query(name, dims, shares, where_sql=None, where=None, segments=(), hidden=False, targets=False,
                method="join", measures=("lives",)):
    @register(name, share_oracle(dims, shares, where_sql, hidden, targets, measures))
    def run(spark, sf_dir):
        df = lives_shares(
            lives_table(spark, sf_dir), shares, dims, where=where() if where else None, segments=segments,
            include_hidden=hidden, targets=TARGETS if targets else None, method=method, measures=measures,
        )
        return shown(df, shares)

    return run


ECO, BEN, BOOK, MONTH = "ecosystem_code", "benefit_type", "book_of_business", "date_year_month"
ALL_SHARES = list(SHARES)

share_query("share_of_ecosystem", [ECO, BEN, MONTH, "payer_id"], ["pct_ecosystem_lives"])
share_query("share_of_nation", [BEN, MONTH, "payer_category"], ["pct_national_lives"])
share_query("share_of_ecosystem_book", [ECO, BEN, BOOK, MONTH, "payer_role"], ["pct_ecosystem_book_lives"])
share_query("share_of_nation_book", [BEN, BOOK, MONTH, "plan_type"], ["pct_national_book_lives"])
share_query("shares_all", [ECO, BEN, BOOK, MONTH, "lives_source"], ALL_SHARES, measures=("lives", "record_count"))
share_query("share_partial_grain", [ECO, BEN, "payer_category"], ["pct_ecosystem_lives", "pct_national_lives"])
share_query("share_grand_total", ["payer_category"], ["pct_national_lives", "pct_ecosystem_lives"], hidden=True)
share_query(
    "share_null_ecosystem", [ECO, BEN, MONTH, "state_code"], ["pct_ecosystem_lives"],
    where_sql=f"{GEO_TYPE} = 'NATIONAL'", segments=["national_level"], hidden=True,
)
share_query(
    "share_filtered", [ECO, BEN, MONTH, "payer_role"], ["pct_ecosystem_lives", "pct_national_lives"],
    where_sql="flag_current_record = 'Y' AND book_of_business = 'Commercial' AND plan_type <> 'UNKNOWN'",
    where=lambda: F.col("plan_type") != "UNKNOWN", segments=["current_commercial"],
)
share_query("share_targets", [ECO, BEN, MONTH, "payer_category"], ["pct_ecosystem_lives", "pct_national_lives"],
            targets=True)
share_query("denominators_hidden", [ECO, BEN, BOOK, MONTH], ALL_SHARES, hidden=True)
share_query("share_window_method", [ECO, BEN, MONTH, "payer_id"], ["pct_ecosystem_lives", "pct_national_lives"],
            method="window")
share_query("share_wide_request_stored", [ECO, BEN, MONTH, "zip", "plan_id"], ["pct_ecosystem_lives", "pct_national_lives"],
            method="stored")
share_query("share_wide_request", [ECO, BEN, MONTH, "zip", "plan_id"], ["pct_ecosystem_lives", "pct_national_lives"])


@register(
    "request_mixed_members",
    f"""WITH a AS (SELECT ecosystem_code, benefit_type, date_year_month, payer_role,
              {LIVES_SUM} AS lives, count(*) AS record_count FROM lives
              WHERE flag_current_record = 'Y' GROUP BY 1, 2, 3, 4),
         d AS (SELECT *, sum(lives) OVER (PARTITION BY ecosystem_code, benefit_type, date_year_month) AS e,
                        sum(lives) OVER (PARTITION BY benefit_type, date_year_month) AS n FROM a)
       SELECT ecosystem_code, benefit_type, date_year_month, payer_role, record_count, lives,
              CAST(n AS BIGINT) AS national_total_lives, {share_sql('lives', 'e')} AS pct_ecosystem_lives
       FROM d""",
)
def request_mixed_members(spark, sf_dir):
    """Additive measures, a share and another share's denominator in one request."""
    from ..operators.request import lives_request

    df = lives_request(
        lives_table(spark, sf_dir),
        ["record_count", "lives", "national_total_lives", "pct_ecosystem_lives"],
        [ECO, BEN, MONTH, "payer_role"],
        where=F.col("flag_current_record") == "Y",
    )
    return shown(df, ["pct_ecosystem_lives"])


@register(
    "share_default_filters",
    share_oracle([ECO, BEN, MONTH, "payer_category"], ["pct_ecosystem_lives", "pct_national_lives"],
                 "flag_current_record = 'Y' AND book_of_business = 'Commercial' AND lives_source = 'DRG Plan'"),
)
def share_default_filters(spark, sf_dir):
    """Shares under the model's default filter values (current, commercial, plan source)."""
    df = lives_shares(lives_table(spark, sf_dir), ["pct_ecosystem_lives", "pct_national_lives"],
                      [ECO, BEN, MONTH, "payer_category"], defaults=True)
    return shown(df, ["pct_ecosystem_lives", "pct_national_lives"])
