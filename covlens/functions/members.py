"""Members of the coverage model as plain Spark Columns.

Dimensions, measures and named filters are looked up by name and returned as
``Column`` expressions. A member used inside another is a Python call giving a
Column, so Catalyst sees one expression tree and folds, simplifies and pushes
it like any other.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schemas import LIVES_TEXT_COLUMNS

# ---------------------------------------------------------------- dimensions

# Columns are built on call: a Column belongs to the running session's JVM.


def geography_type() -> Column:
    """Derived dimension: a NULL ecosystem code marks a national row."""
    return F.when(F.col("ecosystem_code").isNull(), F.lit("NATIONAL")).otherwise(F.lit("ECOSYSTEM"))


DERIVED_DIMENSIONS = {"geography_type": geography_type}

DIMENSION_NAMES: tuple[str, ...] = LIVES_TEXT_COLUMNS[:9] + ("geography_type",) + LIVES_TEXT_COLUMNS[9:]
CONFIG_DIMENSION_NAMES: tuple[str, ...] = ("benefit_type", "gpo_name")


def dimension(name: str) -> Column:
    """The Column of a named dimension, aliased to its name."""
    if name in DERIVED_DIMENSIONS:
        return DERIVED_DIMENSIONS[name]().alias(name)
    if name in LIVES_TEXT_COLUMNS or name in CONFIG_DIMENSION_NAMES:
        return F.col(name)
    raise KeyError(f"unknown dimension {name!r}")


# ------------------------------------------------------------------ measures

# The measures of the model.
MEASURE_NAMES: tuple[str, ...] = ("lives", "record_count", "mx_lives", "rx_lives", "pbm_rx_lives")

# Measures that are sums, so that a sum of stored sums answers them (rollup).
ADDITIVE_SUMS = ("lives", "mx_lives", "rx_lives", "pbm_rx_lives")


def lives_value() -> Column:
    """Row value of the main measure: pharmacy lives, else medical lives."""
    return F.coalesce(F.col("rx_lives"), F.col("mx_lives"))


def measure(name: str) -> Column:
    """The aggregate Column of a named measure, aliased to its name."""
    if name == "lives":
        agg = F.sum(lives_value())
    elif name == "record_count":
        agg = F.count(F.lit(1))
    elif name in ("mx_lives", "rx_lives", "pbm_rx_lives"):
        agg = F.sum(F.col(name))
    else:
        raise KeyError(f"unknown measure {name!r}")
    return agg.alias(name)


def row_measure(name: str) -> Column:
    """The named measure of a single row."""
    if name == "lives":
        return lives_value()
    return F.lit(1) if name == "record_count" else F.col(name)


# ------------------------------------------------------------ named filters

# The literals of the named filters and default filter values.
CURRENT = "Y"
COMMERCIAL = "Commercial"
PLAN_SOURCE = "DRG Plan"
PHARMACY = "Pharmacy Benefit"
MEDICAL = "Medical Benefit"

# The named filters of the model.
SEGMENT_NAMES: tuple[str, ...] = (
    "current_commercial", "ecosystem_level", "national_level", "plan_source", "pharmacy_benefit", "medical_benefit",
)


def segment(name: str) -> Column:
    """The predicate of a named filter."""
    if name == "current_commercial":
        return (F.col("flag_current_record") == CURRENT) & (F.col("book_of_business") == COMMERCIAL)
    if name == "ecosystem_level":
        return geography_type() == "ECOSYSTEM"
    if name == "national_level":
        return geography_type() == "NATIONAL"
    if name == "plan_source":
        return F.col("lives_source") == PLAN_SOURCE
    if name == "pharmacy_benefit":
        return F.col("benefit_type") == PHARMACY
    if name == "medical_benefit":
        return F.col("benefit_type") == MEDICAL
    raise KeyError(f"unknown named filter {name!r}")


# Columns each named filter reads (used by the rollup coverage test).
SEGMENT_COLUMNS: dict[str, tuple[str, ...]] = {
    "current_commercial": ("flag_current_record", "book_of_business"),
    "ecosystem_level": ("geography_type",),
    "national_level": ("geography_type",),
    "plan_source": ("lives_source",),
    "pharmacy_benefit": ("benefit_type",),
    "medical_benefit": ("benefit_type",),
}

# Default filter values the model recommends; applied only on request.
DEFAULT_FILTERS: dict[str, str] = {
    "flag_current_record": CURRENT,
    "book_of_business": COMMERCIAL,
    "lives_source": PLAN_SOURCE,
}


def all_of(conditions) -> Column | None:
    """Conjunction of Columns; ``None`` when there are none."""
    conditions = [c for c in conditions if c is not None]
    return reduce(and_, conditions) if conditions else None


def any_of(conditions) -> Column | None:
    conditions = [c for c in conditions if c is not None]
    return reduce(or_, conditions) if conditions else None


def segment_filter(names) -> Column | None:
    """All named filters must hold."""
    return all_of(segment(n) for n in names)


def default_filter() -> Column:
    return all_of(F.col(c) == v for c, v in DEFAULT_FILTERS.items())


def _param(column: str, values) -> Column | None:
    if values is None:
        return None
    if isinstance(values, Column):
        return values
    if isinstance(values, str):
        values = [values]
    return F.col(column).isin(list(values))


def filter_group(flag_current_record=None, book_of_business=None, lives_source=None, how: str = "and") -> Column | None:
    """The base scan's filter group over its three parameters.

    Each argument is a value, a list of values, or a Column predicate; the
    given ones are combined with ``how`` ("and"/"or") into one predicate, so a
    group mixing AND and OR keeps its logic. No argument means no filter.
    """
    parts = [
        _param("flag_current_record", flag_current_record),
        _param("book_of_business", book_of_business),
        _param("lives_source", lives_source),
    ]
    if how not in ("and", "or"):
        raise ValueError("how must be 'and' or 'or'")
    return all_of(parts) if how == "and" else any_of(parts)
