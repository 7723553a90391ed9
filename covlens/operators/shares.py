"""Shares of an ecosystem or of the nation.

A share divides the main measure of each result row by a denominator summed
at its own fixed grain. Filters reach both stages: one filtered frame feeds
the numerator and the denominators.

Grain (D1): the inner stage groups by the listed dimensions that the request
also has (listed ∩ requested); with ``strict=True`` a request lacking a listed
dimension raises instead.

Plan, ``method="join"`` (default): the request is aggregated once (partial and
final hash aggregation, one shuffle on the request's keys). All denominators
come from one aggregation of the filtered fact at the union of their grains:
a scan of only the grain and lives columns, combined map-side, so its shuffle
is tiny whatever the request's width. Coarser grains are window sums over this
small frame, whose size is bounded by the number of grain values. One
NULL-safe equi-join (D4: a NULL ecosystem is a key value) brings them to the
request rows; the denominator frame, which does not grow with the fact, is
broadcast by hint, so a request as wide as the fact is neither shuffled nor sorted
a second time. ``method="window"``
takes the denominators' frame from the aggregated request instead of a second
scan of the fact: the better choice where the request is far smaller than the
fact, and where the grains have too many values to broadcast: there AQE broadcasts
the frame only when its measured size is under the threshold, else it shuffles and
splits skewed partitions. ``method="stored"`` writes that frame to the shared folder when the plan
is built, so its size is known and a small one is broadcast without shuffling
the request a second time: the better choice for requests nearly as wide as
the fact, at the price of a small job before the query. A request holding none of a grain's dimensions divides by the grand
total, a scalar subquery.

Ratio (D2, D5): numerator as DECIMAL(18,0), NULLIF(denominator, 0) as
DECIMAL(19,0): Spark types the quotient DECIMAL(38,20), the same 18 integer
digits as the model's cast, without rounding the fraction to six places. A
zero or NULL denominator gives NULL; a share is a fraction (D9).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.members import ADDITIVE_SUMS, DIMENSION_NAMES, dimension, lives_value, measure
from ..session import fresh_path
from .summary import filtered_with_hierarchy, lives_summary

# Denominators and their grains, shares and their denominators,
# and the business targets stated for each share (fractions).
DENOMINATORS: dict[str, tuple[str, ...]] = {
    "ecosystem_total_lives": ("ecosystem_code", "benefit_type", "date_year_month"),
    "national_total_lives": ("benefit_type", "date_year_month"),
    "ecosystem_book_total_lives": ("ecosystem_code", "benefit_type", "book_of_business", "date_year_month"),
    "national_book_total_lives": ("benefit_type", "book_of_business", "date_year_month"),
}
SHARES: dict[str, str] = {
    "pct_ecosystem_lives": "ecosystem_total_lives",
    "pct_national_lives": "national_total_lives",
    "pct_ecosystem_book_lives": "ecosystem_book_total_lives",
    "pct_national_book_lives": "national_book_total_lives",
}
TARGETS: dict[str, float] = {
    "pct_ecosystem_lives": 0.20,
    "pct_national_lives": 0.10,
    "pct_ecosystem_book_lives": 0.20,
    "pct_national_book_lives": 0.10,
}

NUMERATOR_TYPE = T.DecimalType(18, 0)
DENOMINATOR_TYPE = T.DecimalType(19, 0)


def share_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / NULLIF(denominator, 0) as DECIMAL(38,20)."""
    return numerator.cast(NUMERATOR_TYPE) / F.nullif(denominator, F.lit(0)).cast(DENOMINATOR_TYPE)


def effective_grain(denominator: str, dimensions: Sequence[str], strict: bool = False) -> list[str]:
    """Listed dimensions of a denominator that the request also has."""
    listed = DENOMINATORS[denominator]
    missing = [c for c in listed if c not in dimensions]
    if strict and missing:
        raise ValueError(f"{denominator} needs the request to hold {missing}")
    return [c for c in listed if c in dimensions]


def _grand_total(base: DataFrame) -> Column:
    return base.select(F.sum(lives_value())).scalar()


def _with_denominators(base: DataFrame, agg: DataFrame, grains: dict[str, list[str]], method: str) -> DataFrame:
    keyed = {d: g for d, g in grains.items() if g}
    out = agg
    if keyed:
        # One small frame at the union of the grains carries every denominator:
        # an aggregate that combines map-side, of the filtered fact (only its
        # grain and lives columns) or of the aggregated request. Coarser grains
        # are window sums over that frame (bounded by the number of grain
        # values, not by the request); one join meets the request.
        union = list(dict.fromkeys(c for g in keyed.values() for c in g))
        if method != "window":
            den = base.groupBy(*[dimension(c) for c in union]).agg(F.sum(lives_value()).alias("__lives"))
        else:
            den = agg.groupBy(*union).agg(F.sum("lives").alias("__lives"))
        for d, g in keyed.items():
            total = F.col("__lives") if set(g) == set(union) else F.sum("__lives").over(Window.partitionBy(*g))
            den = den.withColumn(d, total)
        den = den.select(*[F.col(c).alias(f"__g_{c}") for c in union], *keyed)
        if method == "stored":
            path = fresh_path(den.sparkSession, "denominators")
            den.write.parquet(path)
            den = den.sparkSession.read.schema(den.schema).parquet(path)
        cond = [out[c].eqNullSafe(den[f"__g_{c}"]) for c in union]
        if method == "join":
            den = F.broadcast(den)
        out = out.join(den, cond, "left").drop(*[f"__g_{c}" for c in union])
    for d, g in grains.items():
        if not g:
            out = out.withColumn(d, _grand_total(base))
    return out


def lives_shares(
    df: DataFrame,
    shares: Sequence[str] = ("pct_ecosystem_lives",),
    dimensions: Sequence[str] = (),
    where: Column | None = None,
    segments: Iterable[str] = (),
    defaults: bool = False,
    measures: Sequence[str] = ("lives",),
    include_hidden: bool = False,
    strict: bool = False,
    method: str = "join",
    targets: dict[str, float] | None = None,
    hierarchy: DataFrame | None = None,
    hierarchy_match: str = "both",
    check_hierarchy: bool = True,
) -> DataFrame:
    """Request rows with the main measure, the asked shares and (optionally) their denominators.

    ``targets`` (share name -> fraction) adds a boolean ``meets_<share>`` per
    share that has one; pass ``TARGETS`` for the model's stated targets. A
    dimension of ``hierarchy`` joins it as ``lives_summary`` does (fact summed
    first, then the many-to-one LEFT join); it is never part of a grain, and
    the join keeps every fact row, so the denominators are those of the
    request's own dimensions.
    """
    dims = list(dimensions)
    own = [d for d in dims if d in DIMENSION_NAMES]
    joined = [d for d in dims if d not in DIMENSION_NAMES and hierarchy is not None and d in hierarchy.columns]
    unknown = [d for d in dims if d not in own and d not in joined]
    if unknown:
        raise KeyError(f"unknown dimension {unknown[0]!r}")
    for s in shares:
        if s not in SHARES:
            raise KeyError(f"unknown share {s!r}")
    if method not in ("join", "window", "stored"):
        raise ValueError("method must be 'join', 'window' or 'stored'")
    for m in measures:
        if m not in ADDITIVE_SUMS and m != "record_count":
            raise KeyError(f"unknown measure {m!r}")

    needed = list(dict.fromkeys(SHARES[s] for s in shares))
    grains = {d: effective_grain(d, own, strict) for d in needed}

    wanted = list(dict.fromkeys(["lives", *measures]))
    base, carried = filtered_with_hierarchy(df, where, segments, defaults, hierarchy, hierarchy_match, check_hierarchy)
    if joined and not carried:
        agg = lives_summary(base, wanted, dims, hierarchy=hierarchy, hierarchy_match=hierarchy_match,
                            check_hierarchy=check_hierarchy)
    else:
        aggs = [measure(m) for m in wanted]
        keys = [dimension(d) if d in own else F.col(d) for d in dims]
        agg = base.groupBy(*keys).agg(*aggs) if keys else base.agg(*aggs)

    out = _with_denominators(base, agg, grains, method)
    for s in shares:
        out = out.withColumn(s, share_ratio(F.col("lives"), F.col(SHARES[s])))
    if targets:
        for s in shares:
            if s in targets:
                # A decimal literal keeps the comparison exact (a double would round the share).
                out = out.withColumn(f"meets_{s}", F.col(s) >= F.lit(Decimal(str(targets[s]))))

    visible = [*dims, *dict.fromkeys(["lives", *measures])]
    if "lives" not in measures:
        visible.remove("lives")
    hidden = needed if include_hidden else []
    flags = [f"meets_{s}" for s in shares if targets and s in targets]
    return out.select(*visible, *hidden, *shares, *flags)
