"""Organisation hierarchy join (J1-J3), drills along hierarchies (H1-H5), parent totals (H6).

The join is many-to-one and LEFT: every fact row stays, with NULL hierarchy
columns where nothing matches (D6); it is made only when a hierarchy column
is asked for. The model's condition matches plan id and payer id against the
same hierarchy key; ``match="plan"`` and ``match="payer"`` use one of the two.

No broadcast hint: the planner broadcasts the hierarchy when its measured
size is under the threshold (AQE re-checks at run time), and otherwise plans
a shuffled join whose skewed partitions AQE splits. A repeated key would
multiply fact rows, so the plan groups the hierarchy by its key and raises, as
it runs, where a key has more than one row; no job runs while a plan is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.members import dimension, measure
from ..sources.schemas import HIERARCHY_KEY
from .summary import filtered

# The (disabled) hierarchies of the model, coarse to fine.
HIERARCHIES: dict[str, tuple[str, ...]] = {
    "payer": ("payer_parent_name", "payer_name", "plan_name"),
    "pbm": ("pbm_parent_name", "pbm_name"),
    "geography": ("geography_type", "commercial_region_name", "ecosystem_name", "state_code", "zip"),
    "calendar": ("date_year", "date_year_quarter", "date_year_month"),
    "book": ("book_of_business", "source_book_of_business"),
}

# Parent levels and their id and name columns.
PARENTS: dict[str, tuple[str, str]] = {
    "payer": ("payer_parent_id", "payer_parent_name"),
    "pbm": ("pbm_parent_id", "pbm_parent_name"),
    "gpo": ("gpo_parent_id", "gpo_parent_name"),
}


def duplicate_keys(hierarchy: DataFrame, key: str = HIERARCHY_KEY) -> DataFrame:
    """Hierarchy keys that occur more than once (NULL counts as a key value)."""
    return hierarchy.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def check_many_to_one(hierarchy: DataFrame, key: str = HIERARCHY_KEY) -> None:
    """Raise when the hierarchy key repeats: the join would then fan out."""
    dup = duplicate_keys(hierarchy, key).limit(1).collect()
    if dup:
        raise ValueError(f"hierarchy key {key} is not unique, e.g. {dup[0][key]!r} occurs {dup[0]['rows']} times")


def unique_hierarchy(hierarchy: DataFrame, key: str = HIERARCHY_KEY) -> DataFrame:
    """The hierarchy, one row per key; a query over it fails where a key repeats."""
    others = [c for c in hierarchy.columns if c != key]
    if not others:
        return hierarchy.distinct()
    grouped = hierarchy.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in others])
    repeated = F.raise_error(F.concat(F.lit(f"hierarchy key {key} is not unique: "), F.coalesce(F.col(key), F.lit("NULL"))))
    return grouped.select(key, *[F.when(F.col("__n") > 1, repeated).otherwise(F.col(c)).alias(c) for c in others]).select(*hierarchy.columns)


def _condition(lives: DataFrame, hierarchy: DataFrame, match: str) -> Column:
    base = hierarchy[HIERARCHY_KEY]
    if match == "both":
        return (lives["plan_id"] == base) & (lives["payer_id"] == base)
    if match == "plan":
        return lives["plan_id"] == base
    if match == "payer":
        return lives["payer_id"] == base
    raise ValueError("match must be 'both', 'plan' or 'payer'")


def with_hierarchy(lives: DataFrame, hierarchy: DataFrame, match: str = "both", check: bool = True) -> DataFrame:
    """The lives rows with the hierarchy's columns, LEFT joined many-to-one."""
    if check:
        hierarchy = unique_hierarchy(hierarchy)
    clash = [c for c in hierarchy.columns if c in lives.columns]
    if clash:
        raise ValueError(f"hierarchy columns clash with the fact: {clash}")
    return lives.join(hierarchy, _condition(lives, hierarchy, match), "left")


def _level_name(levels: Sequence[str]) -> Column:
    """Name of the finest level a rollup row is grouped by ('total' for the grand total)."""
    n = len(levels)
    gid = F.grouping_id()
    expr = F.when(gid == 0, F.lit(levels[-1]))
    for depth in range(n - 1, 0, -1):
        expr = expr.when(gid == (1 << (n - depth)) - 1, F.lit(levels[depth - 1]))
    return expr.otherwise(F.lit("total"))


def drill(
    df: DataFrame,
    levels: Sequence[str] | str,
    measures: Sequence[str] = ("lives",),
    where: Column | None = None,
    segments: Iterable[str] = (),
    defaults: bool = False,
) -> DataFrame:
    """Subtotals along ordered levels, coarse to fine, plus the grand total.

    ``grouping_id`` tells a subtotal row (a rolled-up level shows NULL) from a
    real NULL value; ``drill_level`` names the finest level the row holds.
    Spark expands each row once per level map-side and aggregates partially
    before the one shuffle.
    """
    if isinstance(levels, str):
        levels = HIERARCHIES[levels]
    levels = list(levels)
    base = filtered(df, where, segments, defaults)
    return base.rollup(*[dimension(c) for c in levels]).agg(
        *[measure(m) for m in measures],
        F.grouping_id().alias("grouping_id"),
        _level_name(levels).alias("drill_level"),
    )


def parent_totals(
    df: DataFrame,
    parent: str,
    measures: Sequence[str] = ("lives", "record_count"),
    where: Column | None = None,
    segments: Iterable[str] = (),
    defaults: bool = False,
) -> DataFrame:
    """Measures at the parent organisation level (payer, pbm or gpo parent)."""
    pid, pname = PARENTS[parent]
    return filtered(df, where, segments, defaults).groupBy(pid, pname).agg(*[measure(m) for m in measures])
