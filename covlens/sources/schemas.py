"""Declared schemas of the coverage tables.

The model fixes its schema by declaration: 34 text columns and three summed
lives columns on the fact, two text columns on the benefit-type
configuration, and a text key on the organisation hierarchy.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The stored text columns of the lives fact, in declaration order.
LIVES_TEXT_COLUMNS = (
    "benefit_type",
    "ecosystem_code",
    "ecosystem_name",
    "payer_id",
    "payer_name",
    "pbm_id",
    "pbm_name",
    "flag_current_record",
    "book_of_business",
    "zip",
    "date_id",
    "date_year_month",
    "date_year_quarter",
    "date_year",
    "commercial_region_name",
    "source_book_of_business",
    "payer_role",
    "lives_source",
    "plan_id",
    "plan_name",
    "plan_type",
    "payer_category",
    "mco_name",
    "payer_parent_id",
    "payer_parent_name",
    "pbm_parent_id",
    "pbm_parent_name",
    "gpo_id",
    "gpo_name",
    "gpo_parent_id",
    "gpo_parent_name",
    "state_code",
    "row_hashkey",
    "load_time",
)

# The summed lives columns (whole numbers, D3: LongType).
LIVES_NUMBER_COLUMNS = ("rx_lives", "mx_lives", "pbm_rx_lives")

# The ten columns of the declared composite key.
LIVES_KEY = (
    "benefit_type",
    "ecosystem_code",
    "payer_id",
    "pbm_id",
    "zip",
    "date_id",
    "source_book_of_business",
    "lives_source",
    "plan_id",
    "plan_type",
)

LIVES_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in LIVES_TEXT_COLUMNS]
    + [T.StructField(c, T.LongType(), True) for c in LIVES_NUMBER_COLUMNS]
)

CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("benefit_type", T.StringType(), True),
        T.StructField("gpo_name", T.StringType(), True),
    ]
)

HIERARCHY_KEY = "base_mdm_id"

HIERARCHY_SCHEMA = T.StructType(
    [
        T.StructField(HIERARCHY_KEY, T.StringType(), True),
        T.StructField("base_name", T.StringType(), True),
    ]
)


def check_schema(df, declared: T.StructType, what: str) -> None:
    """Raise when a declared column is missing or has another type.

    Extra columns pass (the base scan is a star); Catalyst prunes them.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for field in declared.fields:
        if field.name not in have:
            problems.append(f"missing column {field.name}")
        elif have[field.name] != field.dataType:
            problems.append(f"{field.name} is {have[field.name].simpleString()}, declared {field.dataType.simpleString()}")
    if problems:
        raise ValueError(f"{what}: " + "; ".join(problems))
