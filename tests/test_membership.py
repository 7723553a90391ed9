"""Rows told by a set of keys through bitmaps: exact whatever the bitmaps let through, and no row is shuffled."""

from __future__ import annotations

import pytest
from covlens.operators import history as h
from covlens.operators import membership as m
from covlens.plans.inspect import plan_text
from covlens.session import fresh_path
from pyspark.sql import functions as F


@pytest.mark.parametrize("most", [False, True])
@pytest.mark.parametrize("listed, bits, share", [(1 << 17, 16, 3), (20, 1, 3), (10, 2, 900), (0, 1, 2), (0, 16, 1), (5, 1, 3000)])
def test_chosen_keys_are_told_exactly(spark, monkeypatch, listed, bits, share, most):
    monkeypatch.setattr(m, "LISTED", listed)
    monkeypatch.setattr(m, "BITS_PER_KEY", bits)
    chosen = (F.col("id") % share == 0) != F.lit(most)
    levels = m.levels_of(m.told(spark.range(12_000).select(m.key_digest(["id"]).alias("__k"), chosen.alias("chosen")), "t"), "t")
    assert levels.first != most or share < 3  # begins with the fewer
    assert len(levels.known) > 1 or share == 1 or listed > 20 or share > 2000
    rows = spark.range(12_000).withColumns({"__k": m.key_digest(["id"]), "again": F.lit("x")})
    out = m.with_chosen(rows.unionByName(rows), levels)
    assert out.columns == ["id", "__k", "again", "__chosen"] and out.count() == 24_000
    assert out.filter(F.col("__chosen") != chosen).isEmpty()
    assert "hashpartitioning" not in plan_text(out, "simple") and "Exchange SinglePartition" not in plan_text(out, "simple")


def _merged(spark, monkeypatch, path, loads, **options):
    """The plans of what each load writes, and all versions at the end."""
    plans, plain = [], h._write_in_place

    def write(rows, to):
        plans.append(plan_text(rows, "simple"))
        plain(rows, to)

    monkeypatch.setattr(h, "_write_in_place", write)
    for at, rows in loads:
        h.merge_load(spark, path, rows, at, **options)
    return plans, h.read_history(spark, path, loads[0][1].schema)


def test_whole_rows_that_lie_by_period_are_written_where_they_are(spark, monkeypatch):
    """Neither load's rows cross a shuffle, however many keys changed (more than are listed)."""
    monkeypatch.setattr(m, "LISTED", 50)
    source, path = fresh_path(spark, "t"), fresh_path(spark, "t")
    rows = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.lit(1).cast("long").alias("v"),
                                    F.lit("t").alias("load_time"), (F.col("id") % 3).cast("string").alias("month"))
    rows.write.partitionBy("month").parquet(source)
    rows = spark.read.schema(rows.schema).parquet(source)
    second = rows.filter("month > '0'").withColumn("v", F.when(F.col("k").cast("int") % 2 == 0, 2).otherwise(F.col("v")).cast("long"))
    plans, out = _merged(spark, monkeypatch, path, [("1", rows), ("2", second)], key=["k", "month"], part="month")
    assert not any("hashpartitioning" in p or "Rebalance" in p or "Sort " in p for p in plans)
    counts = {(r["month"], r["v"], r["valid_from"], r["valid_to"]): r["count"]
              for r in out.groupBy("month", "v", "valid_from", "valid_to").count().collect()}
    assert counts == {("0", 1, "1", None): 1334, ("1", 1, "1", None): 667, ("1", 1, "1", "2"): 666, ("1", 2, "2", None): 666,
                      ("2", 1, "1", None): 666, ("2", 1, "1", "2"): 667, ("2", 2, "2", None): 667}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"  # the session's own setting is back


def test_a_load_with_its_periods_spread_over_tasks_is_dealt_out(spark, monkeypatch):
    path = fresh_path(spark, "t")
    rows = spark.range(0, 4000, 1, 8).select(F.col("id").cast("string").alias("k"), F.lit(1).cast("long").alias("v"),
                                             F.lit("t").alias("load_time"), (F.col("id") % 30).cast("string").alias("month"))
    plans, out = _merged(spark, monkeypatch, path, [("1", rows)], key=["k", "month"], part="month")
    assert "REBALANCE" in plans[0].upper() and out.count() == 4000
    assert len(out.inputFiles()) == 30


def test_the_fact_meets_few_suppliers_after_its_last_shuffle(spark, monkeypatch):
    """Same rows as with suppliers met before it; rows of a customer follow each other within a file."""
    from covlens.sources import fixtures

    from conftest import SMALL

    path, direct = fresh_path(spark, "t"), fixtures.derive_lives(spark, SMALL)
    few = fixtures._few_suppliers(spark, SMALL)
    narrow = fixtures._lives_rows(spark, SMALL, named=False, supplied=False)
    assert few is not None and "s_name" not in narrow.columns
    fixtures.write_lives(narrow, path, fixtures._geo(spark, SMALL), few)
    written = spark.read.schema(direct.schema).parquet(path).select(*direct.columns)
    assert written.count() == direct.count() and written.exceptAll(direct).isEmpty()
    order = ["date_id", *fixtures.SELECTIVE_COLUMNS]
    one = written.inputFiles()[0]
    keys = [(tuple(r[c] for c in order), int(r["payer_id"])) for r in spark.read.parquet(one).select(*order, "payer_id").coalesce(1).collect()]
    assert keys == sorted(keys)
    monkeypatch.setattr(fixtures, "FEW_SUPPLIERS", 0)
    assert fixtures._few_suppliers(spark, SMALL) is None
