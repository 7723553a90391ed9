"""Coverage tables derived from the driver's TPC-H-like tables.

The model reads a ready-made lives fact; here Spark derives it from
``lineitem`` and its dimension tables, so that every query's work grows with
the data. The mapping is the one of FIXTURES.md section 2.

Join order for scale: lines meet part while they are narrow, then the order side
(orders + customer), joined at order grain, on the order key in a sort-merge
join. It is hinted so: these are the two largest tables, and a file-size
estimate of the pruned line columns would otherwise broadcast the line side at
small scale and run the whole join as one serial stream. So no line carries its
order's columns through the shuffles of part and orders, nor its supplier's,
which is by far the smallest of these tables and comes last: up to
``FEW_SUPPLIERS`` are counted and then broadcast to the rows that were dealt out.
Nation and region are fixed-size (25 and 5 rows), so they are broadcast by hint;
customer, part and more suppliers are left to the planner, which broadcasts them
only when their measured size is under the threshold (AQE re-checks at run
time) and otherwise uses a shuffled join.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import FREED, app_id, fresh_path, settings, shared_dir
from .schemas import LIVES_SCHEMA

# The fact's folder layout: one folder per year (partition pruning for period filters).
PARTITION_COLUMN = "date_year"

_MATERIALIZED: dict[tuple[str, str, str], str] = {}
_LOCK = threading.Lock()

# Fixed values of the mapping (FIXTURES.md section 2).
BOOK_BY_SEGMENT = {
    "AUTOMOBILE": "Medicare",
    "BUILDING": "Medicaid_FFS",
    "FURNITURE": "Medicare_Advantage",
    "MACHINERY": "Government",
}
REGION_NAME_BY_KEY = {0: "Northeast", 1: "Southeast", 2: "Midwest"}
SOURCE_BOOK_BY_LINE = {0: "Commercial", 1: "Government", 2: "Medicaid", 4: "Medicare", 5: "Managed_Care"}
ROLE_BY_PRIORITY = {"1": "EMPLOYER", "2": "GOVERNMENT", "3": "HEALTH INSURER", "4": "TPA"}
PLAN_TYPE_BY_PART = {0: "HMO", 1: "PPO", 2: "EPO", 3: "POS", 4: "HDHP", 5: "Indemnity"}
STATE_BY_REGION = {0: "CA", 1: "NY", 2: "TX", 3: "FL"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col, mapping: dict, default=None):
    expr = None
    for key, value in mapping.items():
        expr = F.when(col == F.lit(key), F.lit(value)) if expr is None else expr.when(col == F.lit(key), F.lit(value))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def _text(col) -> F.Column:
    return col.cast("string")


def zip_of(custkey) -> F.Column:
    """Five digits of a customer key: its remainder by 100,000, so beyond that many customers share zips."""
    return F.lpad(_text(custkey % 100_000), 5, "0")


def wall_clock(df: DataFrame, name: str) -> F.Column:
    """A timestamp column as the wall-clock time written in the file, whatever the session.

    The driver's files hold zone-less timestamps, which Spark reads as
    TIMESTAMP_NTZ by default. A session that reads them as TIMESTAMP instead
    would shift calendar parts by its own time zone; this undoes that shift.
    """
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.to_utc_timestamp(col, F.current_timezone())
    return col


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, region and region name of each nation (25 rows)."""
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).drop("r_regionkey")


def _with_geo(rows: DataFrame, geo: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(geo), rows.c_nationkey == geo.n_nationkey).drop("c_nationkey")


def _code(col, mapping: dict) -> F.Column:
    """The place (from 1) of a text in a mapping, 0 for any other and for NULL."""
    return _case(col, {key: i for i, key in enumerate(mapping, 1)}, 0).cast("tinyint")


def _by_code(code: F.Column, mapping: dict, default: str) -> F.Column:
    return _case(code, dict(enumerate(mapping.values(), 1)), default)


# Small codes that cross the shuffles packed into one number, each with the count of its values.
LINE_CODES = {"kept": 2, "open": 2}
ORDER_CODES = {"pending": 2, "priority": len(ROLE_BY_PRIORITY) + 1, "segment": len(BOOK_BY_SEGMENT) + 1}


def _flag(condition) -> F.Column:
    """1 where a condition holds, else (NULL too) 0."""
    return F.when(condition, 1).otherwise(0)


def _packed(codes: dict[str, int]) -> F.Column:
    number = F.lit(0)
    for name, values in codes.items():
        number = number * values + F.col(name)
    return number.cast("tinyint")


def _unpacked(number: str, codes: dict[str, int]) -> dict[str, F.Column]:
    out, rest = {}, 1
    for name, values in reversed(codes.items()):
        out[name] = F.floor(F.col(number) / rest) % values
        rest *= values
    return out


#: Suppliers, up to which they go to all tasks and are met after the last shuffle.
FEW_SUPPLIERS = 1 << 20


def _supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")


def _few_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The suppliers if they are few, else None."""
    supplier = _supplier(spark, sf_dir)
    return supplier if supplier.count() <= FEW_SUPPLIERS else None


def _with_supplier(rows: DataFrame, supplier: DataFrame) -> DataFrame:
    return rows.join(supplier, rows.l_suppkey == supplier.s_suppkey).drop("s_suppkey")


def _lives_rows(spark: SparkSession, sf_dir: str, named: bool = True, supplied: bool = True) -> DataFrame:
    """A narrow row for each row of the lives fact: the source columns that ``_lives_columns`` spells out.

    The fact's 37 columns repeat the same few values several times over, so rows cross every shuffle in this form;
    with ``named=False`` the nation is its key alone, to be named by ``_with_geo`` after the last shuffle, and with
    ``supplied=False`` the supplier too, to be met by ``_with_supplier``.
    """
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", _code(F.col("c_mktsegment"), BOOK_BY_SEGMENT).alias("segment")
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", _flag(F.col("o_orderstatus") == "P").alias("pending"),
        _code(F.substring("o_orderpriority", 1, 1), ROLE_BY_PRIORITY).alias("priority"),
    )
    order_side = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", "c_custkey", "c_name", "c_nationkey", _packed(ORDER_CODES).alias("order_codes")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lineitem = table(spark, sf_dir, "lineitem")
    shipped = wall_clock(lineitem, "l_shipdate")
    lineitem = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("qty"),
        _flag(F.col("l_returnflag") != "R").alias("kept"), _flag(F.col("l_linestatus") == "O").alias("open"),
        F.trunc(shipped, "month").alias("shipped"),
    )
    lineitem = lineitem.withColumn("line_codes", _packed(LINE_CODES)).drop(*LINE_CODES)
    lines = lineitem.join(part, lineitem.l_partkey == part.p_partkey).drop("p_partkey")
    rows = lines.hint("merge").join(order_side, lineitem.l_orderkey == order_side.o_orderkey).drop("o_orderkey")
    rows = _with_supplier(rows, _supplier(spark, sf_dir)) if supplied else rows
    return _with_geo(rows, _geo(spark, sf_dir)) if named else rows


def _lives_columns() -> dict[str, F.Column]:
    """The fact's columns over the rows of ``_lives_rows``, by name in declared order."""
    year = _text(F.year("shipped"))
    month2 = F.lpad(_text(F.month("shipped")), 2, "0")
    codes = _unpacked("line_codes", LINE_CODES) | _unpacked("order_codes", ORDER_CODES)
    priority = codes["priority"]
    has_eco = (F.col("l_orderkey") % 5) != 0
    gpo_bucket = F.col("l_suppkey") % 3
    has_gpo = gpo_bucket != 0
    qty = F.col("qty")

    cols = {
        "benefit_type": F.when(F.col("l_linenumber") % 2 == 0, "Medical Benefit").otherwise("Pharmacy Benefit"),
        "ecosystem_code": F.when(has_eco, F.concat(F.lit("ECO"), F.lpad(_text(F.col("n_nationkey")), 3, "0"))),
        "ecosystem_name": F.when(has_eco, F.col("n_name")),
        "payer_id": _text(F.col("c_custkey")),
        "payer_name": F.when(F.col("c_custkey") % 97 != 0, F.col("c_name")),
        "pbm_id": _text(F.col("l_suppkey")),
        "pbm_name": F.col("s_name"),
        "flag_current_record": F.when(codes["open"] == 1, "Y").otherwise("N"),
        "book_of_business": _by_code(codes["segment"], BOOK_BY_SEGMENT, "Commercial"),
        "zip": zip_of(F.col("c_custkey")),
        "date_id": F.concat(year, month2, F.lit("01")),
        "date_year_month": F.concat(year, F.lit("-"), month2),
        "date_year_quarter": F.concat(year, F.lit("-Q"), _text(F.quarter("shipped"))),
        "date_year": year,
        "commercial_region_name": _case(F.col("n_regionkey"), REGION_NAME_BY_KEY, "West"),
        "source_book_of_business": _case(F.col("l_linenumber") % 6, SOURCE_BOOK_BY_LINE),
        "payer_role": _by_code(priority, ROLE_BY_PRIORITY, "PLAN ADMINISTRATOR"),
        "lives_source": F.when(priority.isin(1, 2), "Payer-PBM").otherwise("DRG Plan"),
        "plan_id": _text(F.col("l_partkey")),
        "plan_name": F.col("p_name"),
        "plan_type": _case(F.col("l_partkey") % 7, PLAN_TYPE_BY_PART, "UNKNOWN"),
        "payer_category": F.col("r_name"),
        "mco_name": F.concat(
            F.col("c_name"), F.lit(" ("), F.when(priority == 1, "EMPLOYER").otherwise("MAC"), F.lit(")")
        ),
        "payer_parent_id": F.concat(F.lit("PP"), _text(F.col("n_nationkey"))),
        "payer_parent_name": F.col("n_name"),
        "pbm_parent_id": F.concat(F.lit("BP"), _text(F.col("s_nationkey"))),
        "pbm_parent_name": F.concat(F.lit("PBM_PARENT_"), _text(F.col("s_nationkey"))),
        "gpo_id": F.when(has_gpo, F.concat(F.lit("G"), _text(gpo_bucket))),
        "gpo_name": F.when(has_gpo, F.concat(F.lit("GPO_"), _text(gpo_bucket))),
        "gpo_parent_id": F.when(has_gpo, F.lit("GP0")),
        "gpo_parent_name": F.when(has_gpo, F.lit("GPO_PARENT_0")),
        "state_code": _case(F.col("n_regionkey"), STATE_BY_REGION, "ZZ"),
        "row_hashkey": F.md5(
            F.concat_ws("/", _text(F.col("l_orderkey")), _text(F.col("l_linenumber")),
                        _text(F.col("l_partkey")), _text(F.col("l_suppkey")))
        ),
        "load_time": F.concat(year, F.lit("-"), month2, F.lit("-15T00:00:00Z")),
        "rx_lives": F.when(codes["kept"] == 1, qty),
        "mx_lives": F.when(F.col("l_linenumber") != 7, qty + F.col("l_linenumber")),
        "pbm_rx_lives": F.when(codes["pending"] == 1, qty),
    }
    return {f.name: cols[f.name].cast(f.dataType) for f in LIVES_SCHEMA.fields}


def _spelled(rows: DataFrame) -> DataFrame:
    return rows.select(*[(F.col(name) if name in rows.columns else c).alias(name) for name, c in _lives_columns().items()])


def derive_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lives fact, computed lazily from the driver tables (37 columns)."""
    return _spelled(_lives_rows(spark, sf_dir))


def derive_benefit_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benefit-type configuration: one row per supplier, so it grows with the data.

    Benefit types repeat on purpose (the YAML form declares no key).
    """
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return supplier.select(
        F.when(F.col("s_nationkey") % 2 == 0, "Medical Benefit").otherwise("Pharmacy Benefit").alias("benefit_type"),
        F.concat(F.lit("GPO_"), _text(F.col("s_suppkey") % 3)).alias("gpo_name"),
    )


def derive_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation hierarchy: one row per customer, key unique."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customer.select(_text(F.col("c_custkey")).alias("base_mdm_id"), F.col("c_name").alias("base_name"))


def derive_zip_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zip to ecosystem code and name and state: one row per zip, that of its smallest customer key."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    first = customer.groupBy(zip_of(F.col("c_custkey")).alias("zip")).agg(
        F.min(F.struct("c_custkey", "c_nationkey")).alias("first")
    )
    joined = first.join(F.broadcast(nation), F.col("first.c_nationkey") == nation.n_nationkey)
    return joined.select(
        "zip",
        F.concat(F.lit("ECO"), F.lpad(_text(F.col("n_nationkey")), 3, "0")).alias("ecosystem_code"),
        F.col("n_name").alias("ecosystem_name"),
        _case(F.col("n_regionkey"), STATE_BY_REGION, "ZZ").alias("state_code"),
    )


# Columns whose sort order makes Parquet row-group statistics
# selective for the common filters (book, current flag, source, benefit).
SELECTIVE_COLUMNS = ("book_of_business", "flag_current_record", "lives_source", "benefit_type")


# Rows per file: files of a few hundred MB at scale; every file is a read split.
MAX_ROWS_PER_FILE = 5_000_000

# The fact's texts of digits and hexadecimal digits take about half the bytes of the default's files.
COMPRESSION = "zstd"


def _dealt(rows: DataFrame, column: str, order: list[F.Column], geo: DataFrame | None, supplier: DataFrame | None) -> DataFrame:
    """Narrow rows dealt out by a column of the fact; where they arrive, they get their supplier, their nation's names and are sorted."""
    value = _lives_columns()[column]
    dealt = rows.withColumn("dealt", F.hash(value)).hint("rebalance", "dealt").drop("dealt")
    dealt = dealt if supplier is None else _with_supplier(dealt, F.broadcast(supplier))
    named = dealt if geo is None else _with_geo(dealt, geo)
    return named.withColumn(column, value).sortWithinPartitions(column, *order)


def write_lives(rows: DataFrame, path: str, geo: DataFrame | None = None, supplier: DataFrame | None = None) -> None:
    """Write the rows of ``_lives_rows`` as the fact, laid out for parallel, selective reads.

    One folder per year, so a filter on the year is answered by listing only
    that year's folders. The rebalance hint on the year lets AQE size the
    write partitions from the measured bytes and split a year that holds a
    third of the rows, so files stay balanced and their number follows the
    data. Each file is sorted by year (which the partitioned write needs, so it
    keeps the order), month and the common filter columns, so Parquet
    statistics can skip row groups of other months, books or sources; no file
    exceeds ``MAX_ROWS_PER_FILE`` rows. The customer sorts last: rows of one
    follow each other, and its id, names and zip take less space. Rows are dealt out and sorted as they
    come, narrow, met with ``supplier`` and named by ``geo`` if they are not yet, and spelled out as the fact's columns
    only where they are written. The splitting is AQE's: with AQE off (it is on by default, and in
    ``plans.settings``) the hint is a plain repartition by year. What was
    shuffled is removed once the files are written.
    """
    order = [*[_lives_columns()[c] for c in ("date_id", *SELECTIVE_COLUMNS)], F.col("c_custkey")]
    with settings(rows.sparkSession, FREED):
        (
            _spelled(_dealt(rows, PARTITION_COLUMN, order, geo, supplier))
            .write.mode("overwrite")
            .partitionBy(PARTITION_COLUMN)
            .options(maxRecordsPerFile=MAX_ROWS_PER_FILE, compression=COMPRESSION)
            .parquet(path)
        )


def write_lives_by(spark: SparkSession, sf_dir: str, path: str, column: str) -> None:
    """The fact in one folder for each value of a column, its rows dealt out and sorted narrow as in ``write_lives``."""
    few = _few_suppliers(spark, sf_dir)
    rows = _dealt(_lives_rows(spark, sf_dir, named=False, supplied=few is None), column, [], _geo(spark, sf_dir), few)
    _spelled(rows).write.partitionBy(column).parquet(path, compression=COMPRESSION)


def lives_table_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the stored lives fact for this session and input folder (written on first use)."""
    key = (app_id(spark), shared_dir(spark), sf_dir.rstrip("/"))
    with _LOCK:
        path = _MATERIALIZED.get(key)
        if path is None:
            path = fresh_path(spark, "lives")
            few = _few_suppliers(spark, sf_dir)
            write_lives(_lives_rows(spark, sf_dir, named=False, supplied=few is None), path, _geo(spark, sf_dir), few)
            _MATERIALIZED[key] = path
    return path


def lives_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lives fact as a stored Parquet table in the shared folder.

    Derived and written once per session and input folder, then read back, so
    that later queries scan a columnar table with pushdown instead of
    re-running the seven-way join. The written table also cuts lineage: a lost
    executor costs a re-read, not a re-join. The driver tables are read-only
    inputs, so the stored fact stays valid for the session; a live fact table
    is read with ``read_lives``, which lists its files afresh on every call.
    """
    stored = spark.read.schema(LIVES_SCHEMA).parquet(lives_table_path(spark, sf_dir))
    return stored.select(*LIVES_SCHEMA.fieldNames())  # the year folder column back in declared order
