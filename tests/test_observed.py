"""Rules counted while loads are written: the same report as a pass over the fact."""

from __future__ import annotations

import pytest

from conftest import lives_rows
from covlens.operators import observed as o
from covlens.operators.quality import check_lives
from covlens.session import fresh_path


def _rows(df):
    return sorted(tuple(r) for r in df.select("rule", "checked", "failed", "allowed_fraction", "passed").collect())


def test_loads_add_up_and_a_name_counts_once(spark, lives_small):
    path = fresh_path(spark, "t-observed")
    early, late = lives_small.filter("date_year <= '1995'"), lives_small.filter("date_year > '1995'")
    assert o.load_observed(early, path, "a") and o.load_observed(late, path, "b")
    assert not o.load_observed(late, path, "b")
    assert _rows(o.observed_report(spark, path)) == _rows(check_lives(lives_small))
    assert _rows(o.report_by_load(spark, path).filter("load = 'b'")) == _rows(check_lives(late))
    assert o.read_observed(spark, path).exceptAll(lives_small).isEmpty()


def test_odd_rows_and_an_empty_load(spark):
    path = fresh_path(spark, "t-observed-odd")
    rows = lives_rows(spark, [{}, {"zip": "1", "flag_current_record": "Y"}, {"zip": "12345", "rx_lives": 1}, {"zip": ""}])
    assert o.load_observed(lives_rows(spark, []), path, "none")
    assert all(r["checked"] == 0 and r["passed"] for r in o.observed_report(spark, path).collect())
    assert o.load_observed(rows.withColumn("rule", rows.zip).withColumn("rows", rows.zip), path, "odd")  # other columns are left out
    assert _rows(o.observed_report(spark, path)) == _rows(check_lives(rows))


def test_report_reads_no_row_of_the_fact(spark, lives_small):
    path = fresh_path(spark, "t-observed-plan")
    o.load_observed(lives_small, path, "a")
    assert all("/marks/" in f for f in o.observed_report(spark, path).inputFiles())


def test_counts_are_taken_after_the_shuffle(spark, lives_small):
    """In the writing stage a retried task is counted once; the counts must not move below an exchange."""
    path = fresh_path(spark, "t-observed-shuffled")
    o.load_observed(lives_small.repartition(5, "payer_id"), path, "a")
    assert _rows(o.observed_report(spark, path)) == _rows(check_lives(lives_small))


def test_load_that_dies_is_not_seen(spark, lives_small, monkeypatch):
    path = fresh_path(spark, "t-observed-dies")
    monkeypatch.setattr(o, "row_rules", lambda: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        o.load_observed(lives_small, path, "a")
    monkeypatch.undo()
    assert o.read_observed(spark, path).isEmpty() and o.observed_report(spark, path).isEmpty()
    assert o.load_observed(lives_small, path, "a")
    assert o.read_observed(spark, path).count() == lives_small.count()


def test_stream_of_loads(spark, lives_small):
    source, path = fresh_path(spark, "t-observed-src"), fresh_path(spark, "t-observed-stream")
    for part in ("date_year <= '1995'", "date_year > '1995'"):
        lives_small.filter(part).write.mode("append").parquet(source)
        q = o.start_observed_loads(spark, source, path, f"{path}/_checkpoint", available_now=True)
        q.awaitTermination()
        assert q.exception() is None
    assert o.report_by_load(spark, path).select("load").distinct().count() == 2
    assert _rows(o.observed_report(spark, path)) == _rows(check_lives(lives_small))
