"""Data-quality check jobs (Q1-Q18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.known_keys import add_keys, repeats_of_load
from ..operators.observed import load_observed, observed_report
from ..operators.prepare import CURRENT_GRAIN
from ..operators.quality import (
    FORMATS,
    LIVES_FILLED_MIN,
    US_STATES,
    VALID_VALUES,
    check_lives,
    duplicate_key_rows,
    hash_check,
    key_check,
    lives_range_check,
)
from ..oracle import GEO_TYPE
from ..registry import register
from ..session import fresh_path
from ..sources.fixtures import lives_table
from ..sources.schemas import LIVES_KEY


def _in(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def _rules_sql() -> list[tuple[str, str, str, float]]:
    rules = []
    for col, values in VALID_VALUES.items():
        expr = GEO_TYPE if col == "geography_type" else col
        cond = f"{expr} IN {_in(values)}"
        if col == "source_book_of_business":
            cond += f" OR {col} IS NULL"
        rules.append((f"{col}_valid", "TRUE", cond, 0.0))
    for col, pattern in FORMATS.items():
        rules.append((f"{col}_format", "TRUE", f"regexp_matches({col}, '{pattern}')", 0.0))
    rules.append(("date_id_is_date", "TRUE", "try_strptime(date_id, '%Y%m%d') IS NOT NULL", 0.0))
    rules.append(("state_code_valid", "TRUE", f"state_code IN {_in(US_STATES)}", 0.0))
    rules.append(("payer_name_filled_current", "flag_current_record = 'Y'", "payer_name IS NOT NULL", 0.0))
    rules.append(("plan_name_filled_current", "flag_current_record = 'Y'", "plan_name IS NOT NULL", 0.0))
    rules.append(("load_time_filled", "TRUE", "load_time IS NOT NULL", 0.0))
    rules.append(("load_time_is_time", "TRUE", "TRY_CAST(load_time AS TIMESTAMPTZ) IS NOT NULL", 0.0))
    rules.append(("lives_filled", "TRUE", "coalesce(rx_lives, mx_lives) IS NOT NULL", round(1 - LIVES_FILLED_MIN, 10)))
    rules.append(("mco_name_composed", "TRUE", "mco_name IN (payer_name || ' (EMPLOYER)', payer_name || ' (MAC)')", 0.0))
    return rules


def _report_sql() -> str:
    parts = []
    for name, applies, holds, allowed in _rules_sql():
        a = f"coalesce({applies}, FALSE)"
        h = f"coalesce({holds}, FALSE)"
        parts.append(
            f"""SELECT '{name}' AS rule, count(*) FILTER (WHERE {a}) AS checked,
                count(*) FILTER (WHERE {a} AND NOT {h}) AS failed, CAST({allowed} AS DOUBLE) AS allowed_fraction,
                count(*) FILTER (WHERE {a} AND NOT {h}) <= count(*) FILTER (WHERE {a}) * CAST({allowed} AS DOUBLE)
                  AS passed
                FROM lives"""
        )
    return "\nUNION ALL\n".join(parts)


@register("quality_report", _report_sql())
def quality_report(spark, sf_dir):
    return check_lives(lives_table(spark, sf_dir))


def _key_sql(rule, cols):
    return f"""SELECT '{rule}' AS rule, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated_keys,
        CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_repeats
        FROM (SELECT count(*) AS n FROM lives GROUP BY {', '.join(cols)})"""


@register("quality_key", _key_sql("composite_key", LIVES_KEY))
def quality_key(spark, sf_dir):
    return key_check(lives_table(spark, sf_dir), LIVES_KEY)


@register("quality_key_without_month", _key_sql("key_without_month", CURRENT_GRAIN))
def quality_key_without_month(spark, sf_dir):
    """The key less its month repeats across months (history rows): the check reports it."""
    return key_check(lives_table(spark, sf_dir), CURRENT_GRAIN, what="key_without_month")


@register("quality_hash", _key_sql("hash_key", ["row_hashkey"]))
def quality_hash(spark, sf_dir):
    return hash_check(lives_table(spark, sf_dir))


@register(
    "quality_lives_range",
    """SELECT ecosystem_code, date_year_month, CAST(sum(coalesce(rx_lives, mx_lives)) AS BIGINT) AS lives,
       sum(coalesce(rx_lives, mx_lives)) < 1000 AS below
       FROM lives GROUP BY ecosystem_code, date_year_month
       HAVING coalesce(sum(coalesce(rx_lives, mx_lives)) < 1000 OR sum(coalesce(rx_lives, mx_lives)) > 50000000, TRUE)""",
)
def quality_lives_range(spark, sf_dir):
    return lives_range_check(lives_table(spark, sf_dir), ["ecosystem_code", "date_year_month"])


@register(
    "quality_key_repeats",
    f"""SELECT {', '.join(CURRENT_GRAIN)}, count(*) AS rows FROM lives
        GROUP BY {', '.join(CURRENT_GRAIN)} HAVING count(*) > 1""",
)
def quality_key_repeats(spark, sf_dir):
    """The repeated key values (key less its month), each with its row count."""
    return duplicate_key_rows(lives_table(spark, sf_dir), CURRENT_GRAIN)


@register(
    "quality_key_repeats_payer_plan",
    """SELECT payer_id, plan_id, benefit_type, count(*) AS rows FROM lives
       GROUP BY payer_id, plan_id, benefit_type HAVING count(*) > 1""",
)
def quality_key_repeats_payer_plan(spark, sf_dir):
    """Repeats of a coarser candidate key (payer, plan, benefit type), which recur across months."""
    return duplicate_key_rows(lives_table(spark, sf_dir), ["payer_id", "plan_id", "benefit_type"])


@register(
    "quality_config_key",
    """SELECT 'config_benefit_type' AS rule, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated_keys,
       CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_repeats
       FROM (SELECT count(*) AS n FROM benefit_config GROUP BY benefit_type)""",
)
def quality_config_key(spark, sf_dir):
    """The configuration's declared key (benefit type, JS form) checked for uniqueness: it repeats."""
    from ..sources.fixtures import derive_benefit_config
    from ..sources.readers import read_benefit_config

    config = read_benefit_config(spark, derive_benefit_config(spark, sf_dir))
    return key_check(config, ["benefit_type"], what="config_benefit_type")


@register("quality_report_observed", _report_sql())
def quality_report_observed(spark, sf_dir):
    """The fact arrives in two loads, one of them delivered twice; the report comes from the counts taken as they were written."""
    lives, path = lives_table(spark, sf_dir), fresh_path(spark, "observed")
    early = F.coalesce(F.col("date_year") <= "1995", F.lit(True))
    did = [load_observed(lives.filter(early), path, "early")]
    did += [load_observed(lives.filter(~early), path, "late") for _ in range(2)]
    if did != [True, True, False]:
        raise RuntimeError("a load was written twice or left out")
    return observed_report(spark, path)


def _new_load_sql(key):
    names = ", ".join(key)
    same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM h.{c}" for c in key)
    return f"""WITH l AS (SELECT * FROM lives WHERE date_year > '1998'
              UNION ALL SELECT * FROM lives WHERE date_year IN ('1995', '1997') AND plan_type = 'HMO'),
           n AS (SELECT {names}, count(*) AS in_load FROM l GROUP BY {names}),
           h AS (SELECT {names}, count(*) AS loaded FROM lives WHERE date_year <= '1998' GROUP BY {names})
       SELECT {", ".join(f"n.{c}" for c in key)}, in_load, coalesce(loaded, 0) AS in_history
       FROM n LEFT JOIN h ON {same} WHERE in_load > 1 OR loaded > 0"""


def _new_load(spark, sf_dir, key):
    lives, path = lives_table(spark, sf_dir), fresh_path(spark, "known_keys")
    history = lives.filter("date_year <= '1998'")
    for name, years in (("first", "date_year <= '1996'"), ("second", "date_year > '1996'")):
        add_keys(history.filter(years), path, name, key, "date_year", expected=1 << 20)
    again = lives.filter("date_year IN ('1995', '1997') AND plan_type = 'HMO'")
    load = lives.filter("date_year > '1998'").unionByName(again)
    return repeats_of_load(spark, path, history, load, key, "date_year", scratch=fresh_path(spark, "candidates"))


@register("quality_hash_new_load", _new_load_sql(["row_hashkey"]))
def quality_hash_new_load(spark, sf_dir):
    """Hash keys of the fact's later years, some rows of earlier ones among them, held against all earlier years."""
    return _new_load(spark, sf_dir, ["row_hashkey"])


@register("quality_key_new_load", _new_load_sql(LIVES_KEY))
def quality_key_new_load(spark, sf_dir):
    """The same by the composite key, whose columns may be NULL."""
    return _new_load(spark, sf_dir, list(LIVES_KEY))
