"""Monthly, quarterly and yearly trends (V1-V3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.trends import lives_snapshot, share_trend, trend
from ..oracle import LIVES_SUM, share_sql
from ..registry import register
from ..sources.fixtures import lives_table

_PREV_SQL = {
    "date_year_month": "strftime(CAST(a.date_year_month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')",
    "date_year_quarter": (
        "CASE WHEN substr(a.date_year_quarter, 7, 1) = '1' "
        "THEN CAST(CAST(substr(a.date_year_quarter, 1, 4) AS INT) - 1 AS VARCHAR) || '-Q4' "
        "ELSE substr(a.date_year_quarter, 1, 4) || '-Q' "
        "|| CAST(CAST(substr(a.date_year_quarter, 7, 1) AS INT) - 1 AS VARCHAR) END"
    ),
    "date_year": "CAST(CAST(a.date_year AS INT) - 1 AS VARCHAR)",
}


def _trend_sql(col, by, where=None, source=None):
    keys = [*by, col]
    w = f" WHERE {where}" if where else ""
    on = " AND ".join([f"p.{b} IS NOT DISTINCT FROM a.{b}" for b in by] + [f"p.{col} = {_PREV_SQL[col]}"])
    ratio = (
        "CASE WHEN nullif(p.lives, 0) IS NULL OR a.lives IS NULL THEN NULL ELSE "
        "CAST(sign(a.lives - p.lives) * ((2 * abs(a.lives - p.lives) * 1000000 + p.lives) // (2 * p.lives)) "
        "AS DOUBLE) / 1e6 END"
    )
    sel = ", ".join(f"a.{k}" for k in keys)
    source = source or f"(SELECT {', '.join(keys)}, {LIVES_SUM} AS lives FROM lives{w} GROUP BY {', '.join(keys)})"
    return f"""WITH a AS {source}
        SELECT {sel}, a.lives, p.lives AS previous_lives, a.lives - p.lives AS change, {ratio} AS change_ratio
        FROM a LEFT JOIN a p ON {on}"""


def _shown(df):
    return df.withColumn("change_ratio", F.round("change_ratio", 6).cast("double"))


@register("trend_month", _trend_sql("date_year_month", []))
def trend_month(spark, sf_dir):
    return _shown(trend(lives_table(spark, sf_dir), "month"))


@register(
    "trend_month_current_commercial",
    _trend_sql("date_year_month", ["benefit_type"],
               "flag_current_record = 'Y' AND book_of_business = 'Commercial'"),
)
def trend_month_current_commercial(spark, sf_dir):
    return _shown(trend(lives_table(spark, sf_dir), "month", by=["benefit_type"], segments=["current_commercial"]))


@register("trend_quarter", _trend_sql("date_year_quarter", ["payer_category"]))
def trend_quarter(spark, sf_dir):
    return _shown(trend(lives_table(spark, sf_dir), "quarter", by=["payer_category"]))


@register("trend_year", _trend_sql("date_year", ["benefit_type", "ecosystem_code"]))
def trend_year(spark, sf_dir):
    return _shown(trend(lives_table(spark, sf_dir), "year", by=["benefit_type", "ecosystem_code"]))


def _share_trend_sql(col, by, grain):
    keys = [*by, col]
    on = " AND ".join([f"p.{b} IS NOT DISTINCT FROM a.{b}" for b in by] + [f"p.{col} = {_PREV_SQL[col]}"])
    return f"""WITH g AS (SELECT {', '.join(keys)}, {LIVES_SUM} AS lives FROM lives GROUP BY {', '.join(keys)}),
        a AS (SELECT *, {share_sql('lives', 'n')} AS share FROM
              (SELECT *, sum(lives) OVER (PARTITION BY {', '.join(grain)}) AS n FROM g))
        SELECT {', '.join('a.' + k for k in keys)}, a.lives, a.share AS share, p.share AS previous_share
        FROM a LEFT JOIN a p ON {on}"""


def _share_shown(df, share):
    keys = df.columns[:df.columns.index("lives") + 1]
    six = lambda c, name: F.round(F.col(c), 6).cast("double").alias(name)
    return df.select(*keys, six(share, "share"), six(f"previous_{share}", "previous_share"))


@register("trend_share_month", _share_trend_sql("date_year_month", ["benefit_type", "payer_category"], ["benefit_type", "date_year_month"]))
def trend_share_month(spark, sf_dir):
    out = share_trend(lives_table(spark, sf_dir), "pct_national_lives", "month", ["benefit_type", "payer_category"])
    return _share_shown(out, "pct_national_lives")


@register(
    "trend_share_quarter",
    _share_trend_sql("date_year_quarter", ["ecosystem_code", "benefit_type", "payer_role"],
                     ["ecosystem_code", "benefit_type", "date_year_quarter"]),
)
def trend_share_quarter(spark, sf_dir):
    out = share_trend(lives_table(spark, sf_dir), "pct_ecosystem_lives", "quarter", ["ecosystem_code", "benefit_type", "payer_role"])
    return _share_shown(out, "pct_ecosystem_lives")


def _snapshot_sql(col, by):
    """Totals of the last month of each period and group, beside the previous calendar period's."""
    keys = ", ".join([*by, col])
    months = f"(SELECT {keys}, date_year_month, {LIVES_SUM} AS lives FROM lives GROUP BY ALL)"
    return _trend_sql(col, by, source=f"(SELECT {keys}, last(lives ORDER BY date_year_month) AS lives FROM {months} GROUP BY {keys})")


@register("trend_quarter_snapshot", _snapshot_sql("date_year_quarter", ["payer_category"]))
def trend_quarter_snapshot(spark, sf_dir):
    """A quarter's lives are those of its last month, not three months added up."""
    return _shown(trend(lives_table(spark, sf_dir), "quarter", by=["payer_category"], snapshot=True))


@register("trend_year_snapshot", _snapshot_sql("date_year", ["benefit_type", "ecosystem_code"]))
def trend_year_snapshot(spark, sf_dir):
    return _shown(trend(lives_table(spark, sf_dir), "year", by=["benefit_type", "ecosystem_code"], snapshot=True))


@register(
    "snapshot_by_quarter",
    f"""WITH m AS (SELECT payer_role, date_year_quarter, date_year_month, {LIVES_SUM} AS lives, count(*) AS record_count
          FROM lives GROUP BY ALL)
        SELECT payer_role, date_year_quarter, max(date_year_month) AS as_of_month, last(lives ORDER BY date_year_month) AS lives,
          last(record_count ORDER BY date_year_month) AS record_count FROM m GROUP BY payer_role, date_year_quarter""",
)
def snapshot_by_quarter(spark, sf_dir):
    return lives_snapshot(lives_table(spark, sf_dir), ["lives", "record_count"], ["payer_role"], "quarter")


@register(
    "trend_month_complete",
    f"""WITH a AS (SELECT payer_id, date_year_month, {LIVES_SUM} AS lives FROM lives GROUP BY ALL),
        s AS (SELECT payer_id, strftime(unnest(generate_series(min(CAST(date_year_month || '-01' AS DATE)),
          max(CAST(date_year_month || '-01' AS DATE)), INTERVAL 1 MONTH)), '%Y-%m') AS date_year_month FROM a GROUP BY payer_id)
        SELECT s.payer_id, s.date_year_month, a.lives, p.lives AS previous_lives, a.lives - p.lives AS change
        FROM s LEFT JOIN a ON a.payer_id IS NOT DISTINCT FROM s.payer_id AND a.date_year_month = s.date_year_month
        LEFT JOIN a p ON p.payer_id IS NOT DISTINCT FROM s.payer_id
          AND p.date_year_month = strftime(CAST(s.date_year_month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')""",
)
def trend_month_complete(spark, sf_dir):
    """Months without rows between a payer's first and last one are there, with NULL totals."""
    return trend(lives_table(spark, sf_dir), "month", by=["payer_id"], complete=True).drop("change_ratio")
