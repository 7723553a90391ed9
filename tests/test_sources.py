"""Readers: declared schema, path or catalog name (with punctuation), filter group at the scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from covlens.functions.members import filter_group
from covlens.sources.fixtures import derive_benefit_config, derive_hierarchy
from covlens.sources.readers import read_benefit_config, read_hierarchy, read_lives
from covlens.sources.schemas import LIVES_SCHEMA
from conftest import SMALL, lives_rows


def test_lives_schema_is_declared(lives_small):
    assert lives_small.schema == LIVES_SCHEMA


def test_text_lives_are_rejected(spark, lives_small):
    bad = lives_small.withColumn("rx_lives", F.col("rx_lives").cast("string"))
    with pytest.raises(ValueError, match="rx_lives"):
        read_lives(spark, bad)


def test_missing_column_is_rejected(spark, lives_small):
    with pytest.raises(ValueError, match="missing column zip"):
        read_lives(spark, lives_small.drop("zip"))


def test_catalog_name(spark, lives_small):
    # The session catalog allows letters, digits and _ only; names are quoted per part.
    spark.sql("CREATE DATABASE IF NOT EXISTS cov_poc")
    lives_small.write.mode("overwrite").saveAsTable("cov_poc.coverage_lives")
    by_name = read_lives(spark, "cov_poc.coverage_lives")
    quoted = read_lives(spark, "`cov_poc`.`coverage_lives`")
    assert by_name.count() == quoted.count() == lives_small.count()


def test_filter_group_at_scan(spark, lives_small):
    group = filter_group(["Y"], None, "DRG Plan")
    got = read_lives(spark, lives_small, where=group)
    expected = lives_small.filter((F.col("flag_current_record") == "Y") & (F.col("lives_source") == "DRG Plan"))
    assert got.count() == expected.count() > 0
    assert filter_group() is None


def test_config_and_hierarchy_readers(spark):
    cfg = read_benefit_config(spark, derive_benefit_config(spark, SMALL))
    assert cfg.count() == spark.read.parquet(f"{SMALL}/supplier.parquet").count()
    h = read_hierarchy(spark, derive_hierarchy(spark, SMALL))
    assert h.select("base_mdm_id").distinct().count() == h.count()
    with pytest.raises(ValueError):
        read_hierarchy(spark, h.withColumnRenamed("base_mdm_id", "id"))


def test_calendar_parts_do_not_depend_on_session_zone(spark):
    from covlens.oracle import LIVES_SQL
    from covlens.sources.fixtures import derive_lives
    from oracle_compare import duck

    keys = {"spark.sql.session.timeZone": "America/Los_Angeles",
            "spark.sql.parquet.inferTimestampNTZ.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        cols = ["row_hashkey", "date_id", "date_year_month", "date_year_quarter", "date_year", "load_time"]
        got = sorted(tuple(r) for r in derive_lives(spark, SMALL).select(*cols).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = sorted(duck(SMALL).execute(f"SELECT {', '.join(cols)} FROM ({LIVES_SQL})").fetchall())
    assert got == want


def test_integral_lives_are_widened(spark, lives_small):
    narrow = lives_small.withColumn("rx_lives", F.col("rx_lives").cast("int")).withColumn(
        "mx_lives", F.col("mx_lives").cast("decimal(12,0)"))
    got = read_lives(spark, narrow)
    assert got.schema["rx_lives"].dataType.simpleString() == "bigint"
    assert got.schema["mx_lives"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError, match="pbm_rx_lives"):
        read_lives(spark, lives_small.withColumn("pbm_rx_lives", F.col("pbm_rx_lives").cast("double")))


def test_read_lives_by_path_of_its_own_layout(spark):
    from covlens.sources.fixtures import lives_table, lives_table_path
    from covlens.sources.schemas import LIVES_SCHEMA
    from conftest import SMALL

    df = read_lives(spark, lives_table_path(spark, SMALL))
    assert dict(df.dtypes)["date_year"] == "string"
    assert df.select(*LIVES_SCHEMA.fieldNames()).exceptAll(lives_table(spark, SMALL)).count() == 0


def test_stored_files_are_sorted(spark):
    import glob

    import pyarrow.parquet as pq

    from covlens.sources.fixtures import SELECTIVE_COLUMNS, lives_table_path
    from conftest import SMALL

    files = glob.glob(lives_table_path(spark, SMALL).removeprefix("file:") + "/*/*.parquet")
    assert files
    for f in files:
        rows = pq.read_table(f, columns=["date_id", *SELECTIVE_COLUMNS]).to_pylist()
        keys = [tuple(r.values()) for r in rows]
        assert keys == sorted(keys)


@pytest.mark.parametrize("column, value", [("zip", "01234"), ("payer_id", "007"), ("load_time", "1997-01-15"), ("date_year", "1995"), ("zip", "00001")])
def test_folder_columns_keep_their_text(spark, column, value):
    """A folder's name is text: no leading zero is lost, no date is guessed, and no job runs to find out."""
    from covlens.session import fresh_path

    path = fresh_path(spark, "folders")
    row = {f.name: "x" for f in LIVES_SCHEMA.fields if f.dataType.simpleString() == "string"} | {column: value, "rx_lives": 5}
    lives_rows(spark, [row, row | {column: None}]).write.partitionBy(column).parquet(path)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(path, "read")
    got = read_lives(spark, path)
    reads = len(tracker.getJobIdsForGroup(path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r[column] for r in got.select(column).collect()} == {value, None}
    assert reads <= 1  # Spark's own: the schema from a footer
    assert got.filter(got[column] == value).count() == 1
