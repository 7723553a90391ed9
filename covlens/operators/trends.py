"""Monthly, quarterly and yearly trends of a measure (V1-V3).

Each period's total is set beside the total of the calendar period before it
(NULL when that period has no rows), with the change and the change as a
fraction of the earlier total (DECIMAL(38,20), NULL when the earlier total is
0 or missing). The fact is aggregated once; ``lag`` over the aggregated frame,
partitioned by the ``by`` dimensions and ordered by period, brings the row
before, which counts only when its period is the computed calendar
predecessor, so a gap in the months gives NULL instead of a wrong neighbour.
A window partition holds at most one row per period (a few hundred), so no
task grows with the data.

Lives are a monthly snapshot, so adding up the months of a quarter or a year
counts people once a month. ``snapshot=True`` takes each group's last month of
the period instead (semi-additive: months are never added, other dimensions
are). ``complete=True`` adds the periods without rows between a group's first
and last one, from a calendar sequence, with NULL totals.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.members import dimension, measure
from .shares import SHARES, lives_shares, share_ratio
from .summary import filtered

PERIODS = {"month": "date_year_month", "quarter": "date_year_quarter", "year": "date_year"}


def previous_period(period: str, value: Column) -> Column:
    """The text key of the calendar period before ``value``."""
    if period == "month":
        start = F.to_date(F.concat(value, F.lit("-01")))
        return F.date_format(F.add_months(start, -1), "yyyy-MM")
    year = F.substring(value, 1, 4).cast("int")
    if period == "quarter":
        q = F.substring(value, 7, 1).cast("int")
        prev_year = F.when(q == 1, year - 1).otherwise(year)
        prev_q = F.when(q == 1, F.lit(4)).otherwise(q - 1)
        return F.concat(F.lpad(prev_year.cast("string"), 4, "0"), F.lit("-Q"), prev_q.cast("string"))
    if period == "year":
        return F.lpad((year - 1).cast("string"), 4, "0")
    raise ValueError("period must be month, quarter or year")


_STEP = {"month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}


def period_start(period: str, value: Column) -> Column:
    """The first day of the period that a text key names."""
    if period == "month":
        return F.to_date(F.concat(value, F.lit("-01")))
    month = (F.substring(value, 7, 1).cast("int") - 1) * 3 + 1 if period == "quarter" else F.lit(1)
    return F.make_date(F.substring(value, 1, 4).cast("int"), month, F.lit(1))


def period_key(period: str, day: Column) -> Column:
    """The text key of the period that a day lies in."""
    if period == "month":
        return F.date_format(day, "yyyy-MM")
    year = F.date_format(day, "yyyy")
    return F.concat(year, F.lit("-Q"), F.quarter(day).cast("string")) if period == "quarter" else year


def last_month(months: DataFrame, keys: Sequence[str], names: Sequence[str], month: str = "date_year_month") -> DataFrame:
    """Semi-additive totals: per ``keys``, the totals ``names`` of the last month that has rows, and that month.

    ``months`` holds one row for each key and month, so this second
    aggregation is over an already aggregated frame.
    """
    unplaced = F.max(month).isNull()  # a group without any month has one row
    totals = [F.when(unplaced, F.max(n)).otherwise(F.max_by(n, month)).alias(n) for n in names]
    rows = months.groupBy(*keys).agg(*totals, F.max(month).alias("as_of_month"))
    return rows.select(*keys, "as_of_month", *names)


def lives_snapshot(
    df: DataFrame,
    measures: Sequence[str] = ("lives",),
    dimensions: Sequence[str] = (),
    period: str = "quarter",
    where: Column | None = None,
    segments: Iterable[str] = (),
    defaults: bool = False,
) -> DataFrame:
    """Measures per dimensions and period as of each group's last month in it: dimensions, period, as_of_month, measures."""
    keys = [dimension(d) for d in dimensions] + [F.col(c) for c in dict.fromkeys([PERIODS[period], PERIODS["month"]])]
    months = filtered(df, where, segments, defaults).groupBy(*keys).agg(*[measure(m) for m in measures])
    if period == "month":
        return months.withColumn("as_of_month", F.col(PERIODS["month"])).select(*dimensions, PERIODS["month"], "as_of_month", *measures)
    return last_month(months, [*dimensions, PERIODS[period]], measures)


def completed(totals: DataFrame, period: str, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``totals`` (one row for each ``by`` and period) with the missing periods between a group's first and last one.

    The calendar is a sequence of each group's own, so no group meets another's periods.
    """
    col = PERIODS[period]
    day = period_start(period, F.col(col))
    spans = totals.groupBy(*by).agg(F.min(day).alias("__low"), F.max(day).alias("__high")).filter("__low is not null")
    days = spans.select(*by, F.explode(F.sequence("__low", "__high", F.expr(_STEP[period]))).alias("__day"))
    spine = days.select(*by, period_key(period, F.col("__day")).alias(col)).alias("s")
    if "as_of_month" in totals.columns:
        names = ["as_of_month", *names]
    same = F.lit(True)
    for c in [*by, col]:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    filled = spine.join(totals.alias("t"), same, "left").select(*[f"s.{c}" for c in [*by, col]], *[f"t.{n}" for n in names])
    unplaced = totals.filter(day.isNull()).select(*by, col, *names)  # a period key that is no date stays as it is
    return filled.unionByName(unplaced)


def trend(
    df: DataFrame,
    period: str = "month",
    measure_name: str = "lives",
    by: Sequence[str] = (),
    where: Column | None = None,
    segments: Iterable[str] = (),
    defaults: bool = False,
    snapshot: bool = False,
    complete: bool = False,
) -> DataFrame:
    """A measure per period (and ``by`` dimensions) beside the previous calendar period's value.

    Columns: ``by``, the period, the measure, ``previous_<measure>``, ``change``
    and ``change_ratio`` (change / previous, DECIMAL(38,20), NULL when the
    previous value is 0 or missing). ``snapshot`` and ``complete``: see above.
    """
    col = PERIODS[period]
    by = list(by)
    if snapshot:
        agg = lives_snapshot(df, [measure_name], by, period, where, segments, defaults)
    else:
        keys = [dimension(d) for d in by] + [F.col(col)]
        agg = filtered(df, where, segments, defaults).groupBy(*keys).agg(measure(measure_name))
    if complete:
        agg = completed(agg, period, by, [measure_name])
    w = Window.partitionBy(*by).orderBy(col)
    earlier = F.lag(F.col(col)).over(w) == previous_period(period, F.col(col))
    previous = F.when(earlier, F.lag(F.col(measure_name)).over(w))
    out = agg.withColumn(f"previous_{measure_name}", previous)
    change = F.col(measure_name) - F.col(f"previous_{measure_name}")
    return out.select(
        *by,
        F.col(col),
        F.col(measure_name),
        F.col(f"previous_{measure_name}"),
        change.alias("change"),
        share_ratio(change, F.col(f"previous_{measure_name}")).alias("change_ratio"),
    )


def share_trend(
    df: DataFrame,
    share: str = "pct_national_lives",
    period: str = "month",
    by: Sequence[str] = (),
    where: Column | None = None,
    segments: Iterable[str] = (),
    defaults: bool = False,
) -> DataFrame:
    """A share per period (and ``by`` dimensions) beside the previous calendar period's share.

    The period takes the month's place in the denominator's grain, so a
    quarter's share is that of the quarter's totals. Columns: ``by``, the
    period, lives, the share, ``previous_<share>`` and ``change``.
    """
    col, by = PERIODS[period], list(by)
    month = PERIODS["month"]
    if share not in SHARES:
        raise KeyError(f"unknown share {share!r}")
    rows = filtered(df, where, segments, defaults)
    if col != month:
        rows = rows.withColumn(month, F.col(col))
    out = lives_shares(rows, [share], [*by, month])
    w = Window.partitionBy(*by).orderBy(month)
    earlier = F.lag(F.col(month)).over(w) == previous_period(period, F.col(month))
    out = out.withColumn(f"previous_{share}", F.when(earlier, F.lag(F.col(share)).over(w)))
    change = F.col(share) - F.col(f"previous_{share}")
    return out.select(*by, F.col(month).alias(col), "lives", share, f"previous_{share}", change.alias("change"))
