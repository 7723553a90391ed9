"""Data-quality rules of the model as check jobs (Q1-Q18).

``check_lives`` evaluates the row rules as conditional counts in one
aggregation pass over the fact (partial aggregation map-side, one row
shuffled per task); the one wide result row is turned into one row per rule.
Uniqueness rules (Q9, Q16) and the per-group range of the main measure (Q17)
need a ``groupBy`` each and are separate jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.members import geography_type, lives_value
from ..sources.schemas import LIVES_KEY

# Allowed values per dimension, as the model lists them.
VALID_VALUES: dict[str, tuple[str, ...]] = {
    "benefit_type": ("Pharmacy Benefit", "Medical Benefit"),
    "flag_current_record": ("Y", "N"),
    "book_of_business": ("Commercial", "Medicare", "Medicare_Advantage", "Medicaid_FFS", "Medicaid_Managed",
                         "Government"),
    "geography_type": ("NATIONAL", "ECOSYSTEM"),
    "source_book_of_business": ("Commercial", "Government", "Medicaid", "Medicare", "Managed_Care"),
    "payer_role": ("EMPLOYER", "GOVERNMENT", "HEALTH INSURER", "TPA", "PLAN ADMINISTRATOR"),
    "lives_source": ("DRG Plan", "Payer-PBM"),
    "plan_type": ("HMO", "PPO", "EPO", "POS", "HDHP", "Indemnity"),
}
# Columns where NULL is allowed by the rule (the source book is filled for plan entities only).
NULL_ALLOWED = ("source_book_of_business",)

# Two-letter codes of the 50 US states and the District of Columbia.
US_STATES: tuple[str, ...] = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "DC", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS",
    "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC",
    "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
)

# Text formats of the model's date and time columns.
FORMATS: dict[str, str] = {
    "zip": r"^[0-9]{5}$",
    "date_id": r"^[0-9]{4}(0[1-9]|1[0-2])01$",
    "date_year_month": r"^[0-9]{4}-(0[1-9]|1[0-2])$",
    "date_year_quarter": r"^[0-9]{4}-Q[1-4]$",
    "date_year": r"^[0-9]{4}$",
    "load_time": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$",
}

# The main measure's stated quality threshold and typical range.
LIVES_FILLED_MIN = 0.95
LIVES_RANGE = (1000, 50_000_000)

# The categories of a composed name.
MCO_CATEGORIES = ("EMPLOYER", "MAC")


def _value(col: str) -> Column:
    return geography_type() if col == "geography_type" else F.col(col)


def _holds(cond: Column) -> Column:
    """A rule holds only when its condition is true (NULL counts as failed)."""
    return F.coalesce(cond, F.lit(False))


def row_rules() -> list[tuple[str, Column, Column, float]]:
    """(rule, applies-to predicate, holds predicate, allowed failed fraction)."""
    everywhere = F.lit(True)
    rules: list[tuple[str, Column, Column, float]] = []
    for col, values in VALID_VALUES.items():
        cond = _value(col).isin(list(values))
        if col in NULL_ALLOWED:
            cond = cond | _value(col).isNull()
        rules.append((f"{col}_valid", everywhere, cond, 0.0))
    for col, pattern in FORMATS.items():
        rules.append((f"{col}_format", everywhere, F.col(col).rlike(pattern), 0.0))
    rules.append(("date_id_is_date", everywhere, F.try_to_date(F.col("date_id"), "yyyyMMdd").isNotNull(), 0.0))
    rules.append(("state_code_valid", everywhere, F.col("state_code").isin(list(US_STATES)), 0.0))
    current = F.col("flag_current_record") == "Y"
    rules.append(("payer_name_filled_current", current, F.col("payer_name").isNotNull(), 0.0))
    rules.append(("plan_name_filled_current", current, F.col("plan_name").isNotNull(), 0.0))
    rules.append(("load_time_filled", everywhere, F.col("load_time").isNotNull(), 0.0))
    rules.append(("load_time_is_time", everywhere, F.try_to_timestamp(F.col("load_time")).isNotNull(), 0.0))
    rules.append(("lives_filled", everywhere, lives_value().isNotNull(), round(1.0 - LIVES_FILLED_MIN, 10)))
    mco = None
    for c in MCO_CATEGORIES:
        same = F.col("mco_name") == F.concat(F.col("payer_name"), F.lit(f" ({c})"))
        mco = same if mco is None else mco | same
    rules.append(("mco_name_composed", everywhere, mco, 0.0))
    return rules


def rule_counts() -> list[Column]:
    """Two aggregates a rule: rows it applies to and rows that fail it."""
    aggs = []
    for name, applies, holds, _ in row_rules():
        aggs.append(F.count_if(_holds(applies)).alias(f"{name}__checked"))
        aggs.append(F.count_if(_holds(applies) & ~_holds(holds)).alias(f"{name}__failed"))
    return aggs


def with_verdict(counts: DataFrame) -> DataFrame:
    return counts.withColumn("passed", F.col("failed") <= F.col("checked") * F.col("allowed_fraction"))


def check_lives(df: DataFrame) -> DataFrame:
    """One row per rule: rows checked, rows failed, allowed fraction, passed."""
    wide = df.agg(*rule_counts())
    per_rule = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col(f"{name}__checked").alias("checked"),
            F.col(f"{name}__failed").alias("failed"),
            F.lit(allowed).alias("allowed_fraction"),
        )
        for name, _, _, allowed in row_rules()
    ]
    return with_verdict(wide.select(F.explode(F.array(*per_rule)).alias("r")).select("r.*"))


def key_check(df: DataFrame, key: Sequence[str] = LIVES_KEY, what: str = "composite_key") -> DataFrame:
    """Uniqueness of a key (NULL is a key value): keys, repeated keys, rows in repeats."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.lit(what).alias("rule"),
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_repeats"),
    )


def duplicate_key_rows(df: DataFrame, key: Sequence[str] = LIVES_KEY) -> DataFrame:
    """The key values that repeat, with their row counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def hash_check(df: DataFrame, column: str = "row_hashkey") -> DataFrame:
    return key_check(df, [column], what="hash_key")


def lives_range_check(
    df: DataFrame, grain: Sequence[str], low: int = LIVES_RANGE[0], high: int = LIVES_RANGE[1]
) -> DataFrame:
    """Groups of ``grain`` whose main measure falls outside the typical range (grain is the caller's)."""
    sums = df.groupBy(*grain).agg(F.sum(lives_value()).alias("lives"))
    outside = (F.col("lives") < low) | (F.col("lives") > high)
    return sums.withColumn("below", F.col("lives") < low).filter(F.coalesce(outside, F.lit(True)))
