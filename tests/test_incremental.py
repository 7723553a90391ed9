"""Refresh by what changed: states of sources, parts by period folder, publication by stamp."""

from __future__ import annotations

import os

import pytest
from covlens.operators import incremental
from covlens.operators.incremental import fingerprint, read_current, read_parts, refresh_changed_parts, refresh_on_change
from covlens.operators.rollup import current_version, serve
from covlens.operators.summary import lives_summary
from covlens.plans.inspect import partition_filters
from covlens.session import fresh_path
from covlens.sources.readers import read_lives


def _fact(spark, lives, path, years=None, mode="append"):
    rows = lives if years is None else lives.filter(lives["date_year"].isin(years))
    rows.write.mode(mode).partitionBy("date_id").parquet(path)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _same(spark, source, path):
    want = lives_summary(read_lives(spark, source), ["lives", "pbm_rx_lives"], ["benefit_type", "payer_name"])
    assert _rows(serve(read_parts(spark, path), ["lives", "pbm_rx_lives"], ["benefit_type", "payer_name"])) == _rows(want)


def test_fingerprint_follows_the_files(spark, lives_small):
    source = fresh_path(spark, "t")
    assert fingerprint(spark, source) == "0:0"
    _fact(spark, lives_small, source, ["1995"])
    first = fingerprint(spark, source)
    assert fingerprint(spark, source) == first
    _fact(spark, lives_small, source, ["1996"])
    assert fingerprint(spark, source) != first


def test_only_changed_folders_are_read(spark, lives_small, monkeypatch):
    source, path = fresh_path(spark, "t"), fresh_path(spark, "t")
    _fact(spark, lives_small, source, ["1995", "1996"])
    months = [p["date_id"] for p in lives_small.filter("date_year in ('1995', '1996')").select("date_id").distinct().collect()]
    assert refresh_changed_parts(spark, source, path) == sorted(months)
    _same(spark, source, path)
    assert refresh_changed_parts(spark, source, path) == []
    files = []
    real = read_lives
    monkeypatch.setattr(incremental, "read_lives", lambda *a: files.extend(r[0] for r in real(*a).select("_metadata.file_path").distinct().collect()) or real(*a))
    # A restated month (one file replaced), a new month and one that is gone.
    again = lives_small.filter("date_id = '19950301'").limit(3).cache()
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        _fact(spark, again, source, mode="overwrite")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    _fact(spark, lives_small.filter("date_id = '19970201'"), source)
    gone = source.removeprefix("file:") + "/date_id=19960501"
    os.rename(gone, source.removeprefix("file:") + "-gone")
    assert refresh_changed_parts(spark, source, path) == ["19950301", "19970201"]
    assert {f.split("date_id=")[1][:8] for f in files} == {"19950301", "19970201"}
    pruned = real(spark, source, incremental.F.col("date_id").isin(["19950301"]))
    assert any("date_id" in f for f in partition_filters(pruned))  # other folders are not opened
    _same(spark, source, path)


def test_a_run_that_dies_leaves_the_earlier_parts(spark, lives_small, monkeypatch):
    source, path = fresh_path(spark, "t"), fresh_path(spark, "t")
    _fact(spark, lives_small, source, ["1995"])
    refresh_changed_parts(spark, source, path)
    before = _rows(read_parts(spark, path))
    _fact(spark, lives_small, source, ["1996"])

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(incremental, "publish", dies)
        with pytest.raises(RuntimeError):
            refresh_changed_parts(spark, source, path)
    assert _rows(read_parts(spark, path)) == before
    assert len(refresh_changed_parts(spark, source, path)) == 12
    _same(spark, source, path)


def test_rows_without_a_month_and_folders_without_rows(spark, lives_small):
    from pyspark.sql import functions as F

    source, path = fresh_path(spark, "t"), fresh_path(spark, "t")
    some = lives_small.filter("date_year = '1995'")
    _fact(spark, some.withColumn("date_id", F.when(F.col("date_id") > "19950601", F.col("date_id"))), source)
    some.limit(0).drop("date_id").write.parquet(f"{source}/date_id=19940101")
    read = refresh_changed_parts(spark, source, path)
    assert read[0] == "19940101" and read[-1] == "__HIVE_DEFAULT_PARTITION__"
    _same(spark, source, path)
    assert refresh_changed_parts(spark, source, path) == []


def test_files_outside_period_folders_are_refused(spark, lives_small):
    source = fresh_path(spark, "t")
    lives_small.limit(2).write.parquet(source)
    with pytest.raises(ValueError):
        refresh_changed_parts(spark, source, fresh_path(spark, "t"))


def test_nothing_there(spark):
    with pytest.raises(FileNotFoundError):
        read_parts(spark, fresh_path(spark, "t"))
    with pytest.raises(FileNotFoundError):
        read_current(spark, fresh_path(spark, "t"))


def test_refresh_on_change_keeps_an_old_result(spark, lives_small):
    """The source decides, not the age: no rebuild while its files are the same."""
    source, path = fresh_path(spark, "t"), fresh_path(spark, "t")
    _fact(spark, lives_small, source, ["1995"])
    built = []

    def build(session, where):
        built.append(where)
        return read_lives(session, where).groupBy("benefit_type").count()

    assert refresh_on_change(spark, source, path, build) and not refresh_on_change(spark, source, path, build)
    stamp = current_version(spark, path)
    assert stamp["fingerprint"] == fingerprint(spark, source) and len(built) == 1
    _fact(spark, lives_small, source, ["1997"])
    assert refresh_on_change(spark, source, path, build) and len(built) == 2
    assert _rows(read_current(spark, path)) == _rows(build(spark, source))
