"""DuckDB reference SQL for every registered query.

Each text runs on the driver tables registered as views (lineitem, orders,
...). The coverage tables are common table expressions written independently
of the Spark code (FIXTURES.md section 2), so the comparison checks the Spark
derivation as well as the query. Sums are cast to BIGINT (DuckDB sums to
HUGEINT); shares are rounded half-up to six places with integer arithmetic and
then divided as DOUBLE (FIXTURES.md section 4).
"""

from __future__ import annotations

LIVES_SQL = """
SELECT
  CASE WHEN l_linenumber % 2 = 0 THEN 'Medical Benefit' ELSE 'Pharmacy Benefit' END AS benefit_type,
  CASE WHEN l_orderkey % 5 <> 0 THEN concat('ECO', lpad(CAST(n_nationkey AS VARCHAR), 3, '0')) END AS ecosystem_code,
  CASE WHEN l_orderkey % 5 <> 0 THEN n_name END AS ecosystem_name,
  CAST(c_custkey AS VARCHAR) AS payer_id,
  CASE WHEN c_custkey % 97 <> 0 THEN c_name END AS payer_name,
  CAST(l_suppkey AS VARCHAR) AS pbm_id,
  s_name AS pbm_name,
  CASE WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS flag_current_record,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Medicare' WHEN 'BUILDING' THEN 'Medicaid_FFS'
    WHEN 'FURNITURE' THEN 'Medicare_Advantage' WHEN 'MACHINERY' THEN 'Government' ELSE 'Commercial' END
    AS book_of_business,
  lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip,
  concat(CAST(year(l_shipdate) AS VARCHAR), lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0'), '01') AS date_id,
  concat(CAST(year(l_shipdate) AS VARCHAR), '-', lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0')) AS date_year_month,
  concat(CAST(year(l_shipdate) AS VARCHAR), '-Q', CAST(quarter(l_shipdate) AS VARCHAR)) AS date_year_quarter,
  CAST(year(l_shipdate) AS VARCHAR) AS date_year,
  CASE n_regionkey WHEN 0 THEN 'Northeast' WHEN 1 THEN 'Southeast' WHEN 2 THEN 'Midwest' ELSE 'West' END
    AS commercial_region_name,
  CASE l_linenumber % 6 WHEN 0 THEN 'Commercial' WHEN 1 THEN 'Government' WHEN 2 THEN 'Medicaid'
    WHEN 4 THEN 'Medicare' WHEN 5 THEN 'Managed_Care' END AS source_book_of_business,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'EMPLOYER' WHEN '2' THEN 'GOVERNMENT'
    WHEN '3' THEN 'HEALTH INSURER' WHEN '4' THEN 'TPA' ELSE 'PLAN ADMINISTRATOR' END AS payer_role,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'Payer-PBM' ELSE 'DRG Plan' END AS lives_source,
  CAST(l_partkey AS VARCHAR) AS plan_id,
  p_name AS plan_name,
  CASE l_partkey % 7 WHEN 0 THEN 'HMO' WHEN 1 THEN 'PPO' WHEN 2 THEN 'EPO' WHEN 3 THEN 'POS'
    WHEN 4 THEN 'HDHP' WHEN 5 THEN 'Indemnity' ELSE 'UNKNOWN' END AS plan_type,
  r_name AS payer_category,
  concat(c_name, ' (', CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'EMPLOYER' ELSE 'MAC' END, ')') AS mco_name,
  concat('PP', CAST(n_nationkey AS VARCHAR)) AS payer_parent_id,
  n_name AS payer_parent_name,
  concat('BP', CAST(s_nationkey AS VARCHAR)) AS pbm_parent_id,
  concat('PBM_PARENT_', CAST(s_nationkey AS VARCHAR)) AS pbm_parent_name,
  CASE WHEN l_suppkey % 3 <> 0 THEN concat('G', CAST(l_suppkey % 3 AS VARCHAR)) END AS gpo_id,
  CASE WHEN l_suppkey % 3 <> 0 THEN concat('GPO_', CAST(l_suppkey % 3 AS VARCHAR)) END AS gpo_name,
  CASE WHEN l_suppkey % 3 <> 0 THEN 'GP0' END AS gpo_parent_id,
  CASE WHEN l_suppkey % 3 <> 0 THEN 'GPO_PARENT_0' END AS gpo_parent_name,
  CASE n_regionkey WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' WHEN 3 THEN 'FL' ELSE 'ZZ' END AS state_code,
  md5(concat(CAST(l_orderkey AS VARCHAR), '/', CAST(l_linenumber AS VARCHAR), '/',
             CAST(l_partkey AS VARCHAR), '/', CAST(l_suppkey AS VARCHAR))) AS row_hashkey,
  concat(CAST(year(l_shipdate) AS VARCHAR), '-', lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0'), '-15T00:00:00Z')
    AS load_time,
  CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) END AS rx_lives,
  CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS BIGINT) + l_linenumber END AS mx_lives,
  CASE WHEN o_orderstatus = 'P' THEN CAST(l_quantity AS BIGINT) END AS pbm_rx_lives
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
"""

CONFIG_SQL = """
SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'Medical Benefit' ELSE 'Pharmacy Benefit' END AS benefit_type,
       concat('GPO_', CAST(s_suppkey % 3 AS VARCHAR)) AS gpo_name
FROM supplier
"""

HIERARCHY_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS base_mdm_id, c_name AS base_name FROM customer
"""


def with_tables(body: str) -> str:
    """Prefix a query with the coverage tables as common table expressions."""
    head = (
        f"WITH lives AS ({LIVES_SQL}),\n"
        f"benefit_config AS ({CONFIG_SQL}),\n"
        f"mco_hierarchy AS ({HIERARCHY_SQL})"
    )
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"


def share_sql(num: str, den: str) -> str:
    """A share rounded half-up to six places, as DOUBLE (exact for non-negative integers)."""
    return f"CAST((2 * ({num}) * 1000000 + ({den})) // (2 * nullif({den}, 0)) AS DOUBLE) / 1e6"


LIVES_SUM = "CAST(sum(coalesce(rx_lives, mx_lives)) AS BIGINT)"
GEO_TYPE = "CASE WHEN ecosystem_code IS NULL THEN 'NATIONAL' ELSE 'ECOSYSTEM' END"
