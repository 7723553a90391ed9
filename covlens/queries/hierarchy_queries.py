"""Organisation hierarchy join (J1-J3), drills (H1-H5) and parent totals (H6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.hierarchy import HIERARCHIES, PARENTS, drill, duplicate_keys, parent_totals
from ..operators.summary import lives_summary
from ..oracle import GEO_TYPE, LIVES_SUM, share_sql
from ..registry import register
from ..sources.fixtures import derive_hierarchy, lives_table
from ..sources.readers import read_hierarchy

_JOIN_SQL = {
    "both": "plan_id = base_mdm_id AND payer_id = base_mdm_id",
    "plan": "plan_id = base_mdm_id",
    "payer": "payer_id = base_mdm_id",
}


def _join_query(name, match):
    @register(
        name,
        f"""SELECT base_name, benefit_type, {LIVES_SUM} AS lives, count(*) AS record_count
            FROM lives LEFT JOIN mco_hierarchy ON {_JOIN_SQL[match]}
            GROUP BY base_name, benefit_type""",
    )
    def run(spark, sf_dir):
        hierarchy = read_hierarchy(spark, derive_hierarchy(spark, sf_dir))
        return lives_summary(
            lives_table(spark, sf_dir), ["lives", "record_count"], ["base_name", "benefit_type"],
            hierarchy=hierarchy, hierarchy_match=match,
        )

    return run


_join_query("hierarchy_join", "both")
_join_query("hierarchy_join_plan", "plan")
_join_query("hierarchy_join_payer", "payer")


@register(
    "hierarchy_key_check",
    "SELECT base_mdm_id, count(*) AS rows FROM mco_hierarchy GROUP BY base_mdm_id HAVING count(*) > 1",
)
def hierarchy_key_check(spark, sf_dir):
    return duplicate_keys(derive_hierarchy(spark, sf_dir))


@register(
    "hierarchy_key_check_repeating",
    "SELECT payer_id AS base_mdm_id, count(*) AS rows FROM lives GROUP BY payer_id HAVING count(*) > 1",
)
def hierarchy_key_check_repeating(spark, sf_dir):
    """The many-to-one check on a candidate key that repeats (payer ids of the fact)."""
    candidate = lives_table(spark, sf_dir).select(F.col("payer_id").alias("base_mdm_id"))
    return duplicate_keys(candidate)


def _drill_sql(levels, measures_sql):
    cols = ", ".join(levels)
    n = len(levels)
    cases = " ".join(
        f"WHEN {(1 << (n - depth)) - 1} THEN '{levels[depth - 1]}'" for depth in range(n, 0, -1)
    )
    return f"""SELECT {cols}, {measures_sql}, CAST(GROUPING({cols}) AS BIGINT) AS grouping_id,
        CASE GROUPING({cols}) {cases} ELSE 'total' END AS drill_level
        FROM (SELECT *, {GEO_TYPE} AS geography_type FROM lives) l
        GROUP BY ROLLUP ({cols})"""


def _drill_query(name, hierarchy):
    levels = HIERARCHIES[hierarchy]

    @register(name, _drill_sql(levels, f"{LIVES_SUM} AS lives, count(*) AS record_count"))
    def run(spark, sf_dir):
        return drill(lives_table(spark, sf_dir), hierarchy, ["lives", "record_count"])

    return run


_drill_query("drill_payer", "payer")
_drill_query("drill_pbm", "pbm")
_drill_query("drill_geography", "geography")
_drill_query("drill_calendar", "calendar")
_drill_query("drill_book", "book")


@register(
    "drill_geography_current_commercial",
    _drill_sql(HIERARCHIES["geography"][:3], f"{LIVES_SUM} AS lives").replace(
        "GROUP BY ROLLUP", "WHERE flag_current_record = 'Y' AND book_of_business = 'Commercial' GROUP BY ROLLUP"
    ),
)
def drill_geography_current_commercial(spark, sf_dir):
    return drill(lives_table(spark, sf_dir), HIERARCHIES["geography"][:3], ["lives"], segments=["current_commercial"])


def _parent_query(name, parent):
    pid, pname = PARENTS[parent]

    @register(
        name,
        f"""SELECT {pid}, {pname}, {LIVES_SUM} AS lives, count(*) AS record_count,
            CAST(sum(pbm_rx_lives) AS BIGINT) AS pbm_rx_lives FROM lives GROUP BY {pid}, {pname}""",
    )
    def run(spark, sf_dir):
        return parent_totals(lives_table(spark, sf_dir), parent, ["lives", "record_count", "pbm_rx_lives"])

    return run


_parent_query("totals_payer_parent", "payer")
_parent_query("totals_pbm_parent", "pbm")
_parent_query("totals_gpo_parent", "gpo")


@register(
    "share_by_hierarchy",
    f"""WITH j AS (SELECT l.*, h.base_name FROM lives l LEFT JOIN mco_hierarchy h ON l.plan_id = h.base_mdm_id),
       a AS (SELECT benefit_type, date_year_month, base_name, {LIVES_SUM} AS lives FROM j
             WHERE flag_current_record = 'Y' GROUP BY 1, 2, 3),
       d AS (SELECT *, sum(lives) OVER (PARTITION BY benefit_type, date_year_month) AS n FROM a)
       SELECT benefit_type, date_year_month, base_name, lives, {share_sql('lives', 'n')} AS pct_national_lives FROM d""",
)
def share_by_hierarchy(spark, sf_dir):
    """A national share by a hierarchy column: the join never changes the denominators."""
    from ..operators.shares import lives_shares

    hierarchy = read_hierarchy(spark, derive_hierarchy(spark, sf_dir))
    df = lives_shares(lives_table(spark, sf_dir), ["pct_national_lives"], ["benefit_type", "date_year_month", "base_name"],
                      where=F.col("flag_current_record") == "Y", hierarchy=hierarchy, hierarchy_match="plan")
    return df.withColumn("pct_national_lives", F.round("pct_national_lives", 6).cast("double"))
