"""Additive requests: measures, dimensions, named filters, filter groups, configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.members import DIMENSION_NAMES, filter_group
from ..operators.shares import lives_shares
from ..operators.summary import config_count, lives_summary
from ..oracle import GEO_TYPE, LIVES_SUM, share_sql
from ..registry import register
from ..session import fresh_path
from ..sources.fixtures import COMPRESSION, derive_benefit_config, derive_hierarchy, lives_table, lives_table_path, write_lives_by
from ..sources.readers import read_benefit_config, read_hierarchy, read_lives
from ..sources.schemas import LIVES_SCHEMA

ALL_SUMS_SQL = f"""{LIVES_SUM} AS lives, count(*) AS record_count,
    CAST(sum(mx_lives) AS BIGINT) AS mx_lives, CAST(sum(rx_lives) AS BIGINT) AS rx_lives,
    CAST(sum(pbm_rx_lives) AS BIGINT) AS pbm_rx_lives"""
ALL_MEASURES = ["lives", "record_count", "mx_lives", "rx_lives", "pbm_rx_lives"]


# ------------------------------------------------------------ flagship, S1


@register(
    "lives_by_payer_category_current_commercial",
    f"""SELECT payer_category, {LIVES_SUM} AS lives FROM lives
        WHERE flag_current_record = 'Y' AND book_of_business = 'Commercial'
        GROUP BY payer_category""",
)
def lives_by_payer_category_current_commercial(spark, sf_dir):
    return lives_summary(lives_table(spark, sf_dir), ["lives"], ["payer_category"], segments=["current_commercial"])


@register("scan_lives", "SELECT * FROM lives")
def scan_lives(spark, sf_dir):
    """The whole stored fact by its path, through the declared-schema reader (all 37 columns)."""
    return read_lives(spark, lives_table_path(spark, sf_dir)).select(*LIVES_SCHEMA.fieldNames())


@register("scan_catalog_table", f"SELECT benefit_type, {LIVES_SUM} AS lives, count(*) AS record_count FROM lives GROUP BY 1")
def scan_catalog_table(spark, sf_dir):
    """The fact by a name in the catalog."""
    lives_table(spark, sf_dir).createOrReplaceTempView("covlens_lives")
    return lives_summary(read_lives(spark, "covlens_lives"), ["lives", "record_count"], ["benefit_type"])


@register("scan_after_reload", f"SELECT date_year, {LIVES_SUM} AS lives, count(*) AS record_count FROM lives GROUP BY 1")
def scan_after_reload(spark, sf_dir):
    """A reader called after a load sees the new files: history first, then the rest."""
    path = fresh_path(spark, "reload")
    lives = lives_table(spark, sf_dir)
    lives.filter("date_year <= '1995'").write.parquet(path, compression=COMPRESSION)
    before = read_lives(spark, path)
    lives.filter("date_year > '1995'").write.mode("append").parquet(path, compression=COMPRESSION)
    if before.select("date_year").filter("date_year > '1995'").count():
        raise RuntimeError("a reader opened before the load saw its files")
    return lives_summary(read_lives(spark, path), ["lives", "record_count"], ["date_year"])


# ------------------------------------------------------ filters on any member, F2


@register(
    "filter_geography_by_name",
    f"SELECT payer_role, {LIVES_SUM} AS lives FROM lives WHERE {GEO_TYPE} = 'NATIONAL' AND plan_type <> 'HMO' GROUP BY 1",
)
def filter_geography_by_name(spark, sf_dir):
    where = (F.col("geography_type") == "NATIONAL") & (F.col("plan_type") != "HMO")
    return lives_summary(lives_table(spark, sf_dir), ["lives"], ["payer_role"], where=where)


_BY_NAME = "l.plan_id = h.base_mdm_id WHERE h.base_name >= 'Customer#000000050'"


@register(
    "filter_by_hierarchy_column",
    f"SELECT benefit_type, base_name, {LIVES_SUM} AS lives FROM lives l LEFT JOIN mco_hierarchy h ON {_BY_NAME} GROUP BY 1, 2",
)
def filter_by_hierarchy_column(spark, sf_dir):
    hierarchy = read_hierarchy(spark, derive_hierarchy(spark, sf_dir))
    return lives_summary(lives_table(spark, sf_dir), ["lives"], ["benefit_type", "base_name"],
                         where=F.col("base_name") >= "Customer#000000050", hierarchy=hierarchy, hierarchy_match="plan")


@register(
    "share_filtered_by_hierarchy",
    f"""WITH a AS (SELECT benefit_type, date_year_month, payer_category, {LIVES_SUM} AS lives
          FROM lives l LEFT JOIN mco_hierarchy h ON {_BY_NAME} GROUP BY 1, 2, 3),
        d AS (SELECT *, sum(lives) OVER (PARTITION BY benefit_type, date_year_month) AS n FROM a)
        SELECT benefit_type, date_year_month, payer_category, lives, {share_sql('lives', 'n')} AS pct_national_lives FROM d""",
)
def share_filtered_by_hierarchy(spark, sf_dir):
    """A filter on a hierarchy column reaches the numerator and the denominator."""
    hierarchy = read_hierarchy(spark, derive_hierarchy(spark, sf_dir))
    df = lives_shares(lives_table(spark, sf_dir), ["pct_national_lives"], ["benefit_type", "date_year_month", "payer_category"],
                      where=F.col("base_name") >= "Customer#000000050", hierarchy=hierarchy, hierarchy_match="plan")
    return df.withColumn("pct_national_lives", F.round("pct_national_lives", 6).cast("double"))


# ------------------------------------------------------- measures A1-A5, P10


@register(
    "measures_all_by_benefit_type",
    f"SELECT benefit_type, {ALL_SUMS_SQL} FROM lives GROUP BY benefit_type",
)
def measures_all_by_benefit_type(spark, sf_dir):
    return lives_summary(lives_table(spark, sf_dir), ALL_MEASURES, ["benefit_type"])


@register("measures_total", f"SELECT {ALL_SUMS_SQL} FROM lives")
def measures_total(spark, sf_dir):
    return lives_summary(lives_table(spark, sf_dir), ALL_MEASURES, [])


@register("count_by_state", "SELECT state_code, count(*) AS record_count FROM lives GROUP BY state_code")
def count_by_state(spark, sf_dir):
    return lives_summary(lives_table(spark, sf_dir), ["record_count"], ["state_code"])


@register(
    "lives_by_geography_type",
    f"""SELECT {GEO_TYPE} AS geography_type, {LIVES_SUM} AS lives, count(*) AS record_count
        FROM lives GROUP BY 1""",
)
def lives_by_geography_type(spark, sf_dir):
    return lives_summary(lives_table(spark, sf_dir), ["lives", "record_count"], ["geography_type"])


@register(
    "pbm_lives_by_pbm",
    """SELECT pbm_id, pbm_name, CAST(sum(pbm_rx_lives) AS BIGINT) AS pbm_rx_lives FROM lives
       GROUP BY pbm_id, pbm_name""",
)
def pbm_lives_by_pbm(spark, sf_dir):
    return lives_summary(lives_table(spark, sf_dir), ["pbm_rx_lives"], ["pbm_id", "pbm_name"])


@register(
    "lives_by_plan",
    f"""SELECT plan_id, plan_name, plan_type, {LIVES_SUM} AS lives, CAST(sum(rx_lives) AS BIGINT) AS rx_lives,
        CAST(sum(mx_lives) AS BIGINT) AS mx_lives FROM lives GROUP BY plan_id, plan_name, plan_type""",
)
def lives_by_plan(spark, sf_dir):
    """A wide request: one row per plan (the grouping key has high cardinality)."""
    return lives_summary(lives_table(spark, sf_dir), ["lives", "rx_lives", "mx_lives"], ["plan_id", "plan_name", "plan_type"])


@register(
    "lives_by_zip_month",
    f"""SELECT zip, date_year_month, {LIVES_SUM} AS lives, count(*) AS record_count FROM lives
        GROUP BY zip, date_year_month""",
)
def lives_by_zip_month(spark, sf_dir):
    return lives_summary(lives_table(spark, sf_dir), ["lives", "record_count"], ["zip", "date_year_month"])


# --------------------------------------------------- named filters F3-F8, F10


def _segment_query(name, segments, sql_where):
    @register(
        name,
        f"""SELECT benefit_type, date_year, {LIVES_SUM} AS lives, count(*) AS record_count FROM lives
            WHERE {sql_where} GROUP BY benefit_type, date_year""",
    )
    def run(spark, sf_dir):
        return lives_summary(
            lives_table(spark, sf_dir), ["lives", "record_count"], ["benefit_type", "date_year"], segments=segments
        )

    return run


_segment_query("segment_current_commercial", ["current_commercial"],
               "flag_current_record = 'Y' AND book_of_business = 'Commercial'")
_segment_query("segment_ecosystem", ["ecosystem_level"], f"{GEO_TYPE} = 'ECOSYSTEM'")
_segment_query("segment_national", ["national_level"], f"{GEO_TYPE} = 'NATIONAL'")
_segment_query("segment_plan_source", ["plan_source"], "lives_source = 'DRG Plan'")
_segment_query("segment_pharmacy", ["pharmacy_benefit"], "benefit_type = 'Pharmacy Benefit'")
_segment_query("segment_medical", ["medical_benefit"], "benefit_type = 'Medical Benefit'")
_segment_query(
    "segments_combined",
    ["current_commercial", "ecosystem_level", "plan_source"],
    f"flag_current_record = 'Y' AND book_of_business = 'Commercial' AND {GEO_TYPE} = 'ECOSYSTEM'"
    " AND lives_source = 'DRG Plan'",
)
_segment_query("segments_disjoint", ["pharmacy_benefit", "medical_benefit"], "FALSE")


# ------------------------------------------------------ filter group F1, F2, F9


@register(
    "filter_group_or",
    f"""SELECT payer_role, {LIVES_SUM} AS lives, count(*) AS record_count FROM lives
        WHERE flag_current_record = 'Y' OR book_of_business IN ('Medicare', 'Medicaid_FFS')
           OR lives_source = 'Payer-PBM'
        GROUP BY payer_role""",
)
def filter_group_or(spark, sf_dir):
    group = filter_group("Y", ["Medicare", "Medicaid_FFS"], "Payer-PBM", how="or")
    lives = read_lives(spark, lives_table(spark, sf_dir), where=group)
    return lives_summary(lives, ["lives", "record_count"], ["payer_role"])


@register(
    "filter_group_mixed",
    f"""SELECT payer_role, {LIVES_SUM} AS lives FROM lives
        WHERE (flag_current_record = 'Y' AND book_of_business = 'Commercial') OR lives_source = 'Payer-PBM'
        GROUP BY payer_role""",
)
def filter_group_mixed(spark, sf_dir):
    group = (F.col("flag_current_record") == "Y") & (F.col("book_of_business") == "Commercial")
    group = group | (F.col("lives_source") == "Payer-PBM")
    lives = read_lives(spark, lives_table(spark, sf_dir), where=group)
    return lives_summary(lives, ["lives"], ["payer_role"])


@register(
    "filter_group_and",
    f"""SELECT lives_source, {LIVES_SUM} AS lives FROM lives
        WHERE flag_current_record = 'Y' AND book_of_business = 'Commercial' AND lives_source = 'DRG Plan'
        GROUP BY lives_source""",
)
def filter_group_and(spark, sf_dir):
    group = filter_group("Y", "Commercial", "DRG Plan")
    return lives_summary(read_lives(spark, lives_table(spark, sf_dir), where=group), ["lives"], ["lives_source"])


@register(
    "filter_group_empty",
    f"SELECT lives_source, {LIVES_SUM} AS lives, count(*) AS record_count FROM lives GROUP BY lives_source",
)
def filter_group_empty(spark, sf_dir):
    group = filter_group()
    lives = read_lives(spark, lives_table(spark, sf_dir), where=group)
    return lives_summary(lives, ["lives", "record_count"], ["lives_source"])


@register(
    "caller_filter",
    f"""SELECT ecosystem_name, {LIVES_SUM} AS lives FROM lives
        WHERE plan_type IN ('HMO', 'PPO') AND date_year >= '1996' AND payer_name IS NOT NULL
        GROUP BY ecosystem_name""",
)
def caller_filter(spark, sf_dir):
    where = F.col("plan_type").isin("HMO", "PPO") & (F.col("date_year") >= "1996") & F.col("payer_name").isNotNull()
    return lives_summary(lives_table(spark, sf_dir), ["lives"], ["ecosystem_name"], where=where)


@register(
    "default_filters",
    f"""SELECT payer_category, benefit_type, {LIVES_SUM} AS lives FROM lives
        WHERE flag_current_record = 'Y' AND book_of_business = 'Commercial' AND lives_source = 'DRG Plan'
        GROUP BY payer_category, benefit_type""",
)
def default_filters(spark, sf_dir):
    return lives_summary(lives_table(spark, sf_dir), ["lives"], ["payer_category", "benefit_type"], defaults=True)


# ------------------------------------------------------------ dimensions P1-P35

_VALUE_DIMS = ["benefit_type", "geography_type", "lives_source", "book_of_business", "flag_current_record",
               "payer_role", "plan_type", "state_code", "commercial_region_name", "source_book_of_business"]


@register(
    "dimension_values",
    f"""SELECT DISTINCT benefit_type, {GEO_TYPE} AS geography_type, lives_source, book_of_business,
        flag_current_record, payer_role, plan_type, state_code, commercial_region_name, source_book_of_business
        FROM lives""",
)
def dimension_values(spark, sf_dir):
    return lives_summary(lives_table(spark, sf_dir), [], _VALUE_DIMS)


_EVERY_DIM_SQL = ", ".join(f"{GEO_TYPE} AS geography_type" if d == "geography_type" else d for d in DIMENSION_NAMES)
_EVERY_DIM_GROUP = ", ".join(str(i + 1) for i in range(len(DIMENSION_NAMES)))


@register(
    "group_by_every_dimension",
    f"SELECT {_EVERY_DIM_SQL}, {ALL_SUMS_SQL} FROM lives GROUP BY {_EVERY_DIM_GROUP}",
)
def group_by_every_dimension(spark, sf_dir):
    return lives_summary(lives_table(spark, sf_dir), ALL_MEASURES, list(DIMENSION_NAMES), wide=True)


@register(
    "lives_by_time",
    f"""SELECT date_id, date_year_month, date_year_quarter, date_year, {LIVES_SUM} AS lives FROM lives
        GROUP BY date_id, date_year_month, date_year_quarter, date_year""",
)
def lives_by_time(spark, sf_dir):
    return lives_summary(lives_table(spark, sf_dir), ["lives"], ["date_id", "date_year_month", "date_year_quarter", "date_year"])


@register(
    "lives_by_organisation",
    f"""SELECT payer_parent_id, payer_parent_name, pbm_parent_id, pbm_parent_name, gpo_id, gpo_name,
        gpo_parent_id, gpo_parent_name, mco_name, {LIVES_SUM} AS lives FROM lives
        GROUP BY payer_parent_id, payer_parent_name, pbm_parent_id, pbm_parent_name, gpo_id, gpo_name,
        gpo_parent_id, gpo_parent_name, mco_name""",
)
def lives_by_organisation(spark, sf_dir):
    dims = ["payer_parent_id", "payer_parent_name", "pbm_parent_id", "pbm_parent_name", "gpo_id", "gpo_name",
            "gpo_parent_id", "gpo_parent_name", "mco_name"]
    return lives_summary(lives_table(spark, sf_dir), ["lives"], dims)


@register(
    "scan_by_zip_folders",
    f"SELECT zip, {LIVES_SUM} AS lives, count(*) AS record_count FROM lives GROUP BY zip",
)
def scan_by_zip_folders(spark, sf_dir):
    """The fact stored by a text column: every character of a folder's name is kept."""
    path = fresh_path(spark, "lives_by_zip")
    write_lives_by(spark, sf_dir, path, "zip")
    return lives_summary(read_lives(spark, path), ["lives", "record_count"], ["zip"])


# ------------------------------------------------------ configuration S2, S3, A6, A7


@register("config_count", "SELECT count(*) AS record_count FROM benefit_config")
def config_count_total(spark, sf_dir):
    return config_count(read_benefit_config(spark, derive_benefit_config(spark, sf_dir)))


@register(
    "config_count_by_benefit_type",
    "SELECT benefit_type, count(*) AS record_count FROM benefit_config GROUP BY benefit_type",
)
def config_count_by_benefit_type(spark, sf_dir):
    return config_count(read_benefit_config(spark, derive_benefit_config(spark, sf_dir)), ["benefit_type"])


@register(
    "config_count_by_gpo",
    "SELECT benefit_type, gpo_name, count(*) AS record_count FROM benefit_config GROUP BY benefit_type, gpo_name",
)
def config_count_by_gpo(spark, sf_dir):
    return config_count(read_benefit_config(spark, derive_benefit_config(spark, sf_dir)), ["benefit_type", "gpo_name"])
