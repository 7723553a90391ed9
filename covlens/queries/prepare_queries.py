"""Preparation jobs for the fact's derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.history import merge_load, read_history
from ..operators.prepare import (
    CURRENT_GRAIN,
    HASH_COLUMNS,
    apply_book_rules,
    apply_zip_lookup,
    current_flag,
    dedup,
    detect_changes,
    mco_name,
    row_hash,
    union_feeds,
    with_calendar,
    with_load_time,
)
from ..registry import register
from ..session import fresh_path
from ..sources.fixtures import derive_zip_table, lives_table, table, wall_clock
from ..sources.schemas import LIVES_NUMBER_COLUMNS


@register(
    "prepare_calendar",
    """SELECT strftime(d, '%Y-%m-%d') AS ship_date, strftime(date_trunc('month', d), '%Y%m%d') AS date_id,
       strftime(d, '%Y-%m') AS date_year_month,
       CAST(year(d) AS VARCHAR) || '-Q' || CAST(quarter(d) AS VARCHAR) AS date_year_quarter,
       CAST(year(d) AS VARCHAR) AS date_year
       FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)""",
)
def prepare_calendar(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    days = lineitem.select(F.to_date(wall_clock(lineitem, "l_shipdate")).alias("d")).distinct()
    out = with_calendar(days, "d")
    return out.select(F.date_format("d", "yyyy-MM-dd").alias("ship_date"), "date_id", "date_year_month",
                      "date_year_quarter", "date_year")


@register(
    "prepare_zip_lookup",
    """WITH f AS (SELECT lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip,
         arg_min(c_nationkey, c_custkey) AS c_nationkey FROM customer GROUP BY 1),
       z AS (SELECT zip,
         'ECO' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS ecosystem_code, n_name AS ecosystem_name,
         CASE n_regionkey WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' WHEN 3 THEN 'FL' ELSE 'ZZ' END
           AS state_code
         FROM f JOIN nation ON c_nationkey = n_nationkey)
       SELECT l.row_hashkey, l.zip, z.ecosystem_code, z.ecosystem_name, z.state_code
       FROM lives l LEFT JOIN z ON l.zip = z.zip""",
)
def prepare_zip_lookup(spark, sf_dir):
    lives = lives_table(spark, sf_dir).select("row_hashkey", "zip", "ecosystem_code", "ecosystem_name", "state_code")
    out = apply_zip_lookup(lives, derive_zip_table(spark, sf_dir))
    return out.select("row_hashkey", "zip", "ecosystem_code", "ecosystem_name", "state_code")


@register(
    "prepare_mco_name",
    """SELECT row_hashkey, payer_name || ' (' || CASE WHEN payer_role = 'EMPLOYER' THEN 'EMPLOYER' ELSE 'MAC' END
       || ')' AS mco_name FROM lives""",
)
def prepare_mco_name(spark, sf_dir):
    lives = lives_table(spark, sf_dir)
    category = F.when(F.col("payer_role") == "EMPLOYER", "EMPLOYER").otherwise("MAC")
    return lives.select("row_hashkey", mco_name(F.col("payer_name"), category).alias("mco_name"))


def _hash_sql(cols) -> str:
    values = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"sha256(to_json([{values}]::VARCHAR[]))"


@register("prepare_hash", f"SELECT row_hashkey, {_hash_sql(HASH_COLUMNS)} AS content_hash FROM lives")
def prepare_hash(spark, sf_dir):
    return lives_table(spark, sf_dir).select("row_hashkey", row_hash(HASH_COLUMNS).alias("content_hash"))


_CHANGE_COLS = list(HASH_COLUMNS) + list(LIVES_NUMBER_COLUMNS)
_CUR_SELECT = ", ".join(
    "CASE WHEN plan_type = 'HMO' THEN rx_lives + 1 ELSE rx_lives END AS rx_lives" if c == "rx_lives" else c
    for c in ["row_hashkey", *_CHANGE_COLS]
)


@register(
    "prepare_changes",
    f"""WITH prev0 AS (SELECT * FROM lives WHERE date_year <= '1997'
                      QUALIFY row_number() OVER (PARTITION BY row_hashkey ORDER BY load_time DESC) = 1),
       prev AS (SELECT row_hashkey AS k, {_hash_sql(_CHANGE_COLS)} AS h FROM prev0),
       cur0 AS (SELECT {_CUR_SELECT} FROM lives WHERE date_year >= '1996'
                QUALIFY row_number() OVER (PARTITION BY row_hashkey ORDER BY load_time DESC) = 1),
       cur AS (SELECT row_hashkey AS k, {_hash_sql(_CHANGE_COLS)} AS h FROM cur0)
       SELECT coalesce(prev.k, cur.k) AS row_hashkey,
         CASE WHEN prev.k IS NULL THEN 'insert' WHEN cur.k IS NULL THEN 'delete'
              WHEN prev.h = cur.h THEN 'same' ELSE 'update' END AS change
       FROM prev FULL OUTER JOIN cur ON prev.k = cur.k""",
)
def prepare_changes(spark, sf_dir):
    """Two loads from the fact: up to 1997, and from 1996 with HMO pharmacy lives revised.

    The driver data repeats a line key with two ship dates, so each load keeps its newest row per key.
    """
    lives = lives_table(spark, sf_dir).select("row_hashkey", "load_time", *_CHANGE_COLS)
    previous = lives.filter(F.col("date_year") <= "1997")
    revised = F.when(F.col("plan_type") == "HMO", F.col("rx_lives") + 1).otherwise(F.col("rx_lives"))
    current = lives.filter(F.col("date_year") >= "1996").withColumn("rx_lives", revised)
    return detect_changes(previous, current, "row_hashkey", _CHANGE_COLS, newest_by=["load_time"])


@register(
    "prepare_current_flag",
    f"""SELECT row_hashkey, CASE WHEN date_id || '|' || load_time =
         max(date_id || '|' || load_time) OVER (PARTITION BY {', '.join(CURRENT_GRAIN)}) THEN 'Y' ELSE 'N' END
         AS flag_current_record
       FROM lives""",
)
def prepare_current_flag(spark, sf_dir):
    lives = lives_table(spark, sf_dir).select("row_hashkey", "date_id", "load_time", *CURRENT_GRAIN)
    return current_flag(lives).select("row_hashkey", "flag_current_record")


# An example rule set (priority, conditions, resulting book of business).
BOOK_RULES = [
    (1, "Medicare", "HEALTH INSURER", None, "Medicare_Advantage"),
    (2, "Medicare", None, None, "Medicare"),
    (3, "Medicaid", "GOVERNMENT", None, "Medicaid_FFS"),
    (4, "Medicaid", None, None, "Medicaid_Managed"),
    (5, "Government", None, None, "Government"),
    (6, None, "GOVERNMENT", "HMO", "Government"),
]


@register(
    "prepare_book_rules",
    """SELECT row_hashkey, source_book_of_business, payer_role, plan_type,
       CASE WHEN source_book_of_business = 'Medicare' AND payer_role = 'HEALTH INSURER' THEN 'Medicare_Advantage'
            WHEN source_book_of_business = 'Medicare' THEN 'Medicare'
            WHEN source_book_of_business = 'Medicaid' AND payer_role = 'GOVERNMENT' THEN 'Medicaid_FFS'
            WHEN source_book_of_business = 'Medicaid' THEN 'Medicaid_Managed'
            WHEN source_book_of_business = 'Government' THEN 'Government'
            WHEN payer_role = 'GOVERNMENT' AND plan_type = 'HMO' THEN 'Government'
            ELSE 'Commercial' END AS book_of_business
       FROM lives""",
)
def prepare_book_rules(spark, sf_dir):
    rules = spark.createDataFrame(
        BOOK_RULES,
        "priority int, source_book_of_business string, payer_role string, plan_type string, book_of_business string",
    )
    lives = lives_table(spark, sf_dir).select("row_hashkey", "source_book_of_business", "payer_role", "plan_type")
    return apply_book_rules(lives, rules)


@register("prepare_load_time", "SELECT row_hashkey, '2026-03-01T00:00:00Z' AS load_time FROM lives")
def prepare_load_time(spark, sf_dir):
    return with_load_time(lives_table(spark, sf_dir).select("row_hashkey"), at="2026-03-01T00:00:00Z")


@register(
    "prepare_feed_union",
    """SELECT row_hashkey, plan_id, rx_lives, mx_lives, 'DRG Plan' AS lives_source,
              CAST(NULL AS VARCHAR) AS pbm_id, CAST(NULL AS BIGINT) AS pbm_rx_lives
       FROM lives WHERE lives_source = 'DRG Plan'
       UNION ALL
       SELECT row_hashkey, NULL, NULL, NULL, 'Payer-PBM', pbm_id, pbm_rx_lives
       FROM lives WHERE lives_source = 'Payer-PBM'""",
)
def prepare_feed_union(spark, sf_dir):
    lives = lives_table(spark, sf_dir)
    plan_feed = lives.filter(F.col("lives_source") == "DRG Plan").select("row_hashkey", "plan_id", "rx_lives", "mx_lives")
    pbm_feed = lives.filter(F.col("lives_source") == "Payer-PBM").select("row_hashkey", "pbm_id", "pbm_rx_lives")
    return union_feeds({"DRG Plan": plan_feed, "Payer-PBM": pbm_feed})


_DOUBLED_SQL = """SELECT row_hashkey, plan_type, rx_lives, load_time FROM lives
       UNION ALL SELECT row_hashkey, plan_type, rx_lives, load_time FROM lives WHERE plan_type = 'HMO'"""


def _doubled(spark, sf_dir):
    lives = lives_table(spark, sf_dir).select("row_hashkey", "plan_type", "rx_lives", "load_time")
    return lives.unionByName(lives.filter(F.col("plan_type") == "HMO"))


@register(
    "prepare_dedup",
    f"""WITH d AS ({_DOUBLED_SQL}), newest AS (SELECT row_hashkey, max(load_time) AS m FROM d GROUP BY row_hashkey)
        SELECT DISTINCT d.row_hashkey, d.plan_type, d.rx_lives, d.load_time
        FROM d JOIN newest ON d.row_hashkey = newest.row_hashkey AND d.load_time = newest.m""",
)
def prepare_dedup(spark, sf_dir):
    """Copies of a key: the newest load wins (the driver data repeats a line with two ship dates)."""
    return dedup(_doubled(spark, sf_dir), "row_hashkey", newest_by=["load_time"])


@register(
    "prepare_dedup_any",
    f"SELECT DISTINCT row_hashkey, plan_type FROM ({_DOUBLED_SQL})",
)
def prepare_dedup_any(spark, sf_dir):
    """Any one copy per key; only columns equal across copies are shown, so the result is stable."""
    return dedup(_doubled(spark, sf_dir), "row_hashkey").select("row_hashkey", "plan_type")


@register(
    "prepare_merge_load",
    """WITH later AS (SELECT * FROM lives WHERE date_year > '1995' AND payer_role = 'GOVERNMENT'),
       v AS (SELECT date_year, payer_role, rx_lives, '2026-01' AS valid_from,
               CASE WHEN date_year > '1995' AND payer_role = 'GOVERNMENT' THEN '2026-02' END AS valid_to FROM lives
             UNION ALL SELECT date_year, payer_role, coalesce(rx_lives, 0) + 1, '2026-02', NULL FROM later)
       SELECT date_year, payer_role, valid_from, valid_to, count(*) AS record_count, CAST(sum(rx_lives) AS BIGINT) AS rx_lives
       FROM v GROUP BY ALL""",
)
def prepare_merge_load(spark, sf_dir):
    """The whole fact is loaded, then a load that restates some rows of its later years; the earlier years keep their files."""
    lives, path = lives_table(spark, sf_dir), fresh_path(spark, "history")
    first = merge_load(spark, path, lives, "2026-01", part="date_year")
    later = lives.filter("date_year > '1995'")
    restated = F.when(F.col("payer_role") == "GOVERNMENT", F.coalesce("rx_lives", F.lit(0)) + 1).otherwise(F.col("rx_lives"))
    second = merge_load(spark, path, later.withColumn("rx_lives", restated), "2026-02", part="date_year")
    if not set(second) < set(first):
        raise RuntimeError("periods without changes were rewritten")
    versions = read_history(spark, path, lives.schema).groupBy("date_year", "payer_role", "valid_from", "valid_to")
    return versions.agg(F.count(F.lit(1)).alias("record_count"), F.sum("rx_lives").alias("rx_lives"))
