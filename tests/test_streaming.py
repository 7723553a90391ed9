"""The rollup refresh stream: several micro-batches give the rollup of the whole fact."""

from __future__ import annotations

from covlens.operators.rollup import serve
from covlens.operators.summary import lives_summary
from covlens.session import fresh_path
from covlens.sources.fixtures import lives_table_path
from covlens.streaming.refresh import compact, read_refreshed_rollup, start_rollup_refresh
from conftest import SMALL


def test_stream_in_batches_equals_direct(spark):
    source = lives_table_path(spark, SMALL)
    path = fresh_path(spark, "test-stream")
    q = start_rollup_refresh(spark, source, path, f"{path}/_checkpoint", available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    assert q.exception() is None
    parts = read_refreshed_rollup(spark, path)
    assert parts.inputFiles(), "no partial rollups written"
    dims = ["benefit_type", "geography_type", "payer_role"]
    served = serve(parts, ["lives", "pbm_rx_lives"], dims)
    direct = lives_summary(spark.read.parquet(source), ["lives", "pbm_rx_lives"], dims)
    assert served.exceptAll(direct).count() == 0 and direct.exceptAll(served).count() == 0
    compact(spark, path)
    compacted = serve(read_refreshed_rollup(spark, path), ["lives"], dims)
    assert compacted.exceptAll(direct.drop("pbm_rx_lives")).count() == 0


def test_restart_processes_nothing_twice(spark):
    source = lives_table_path(spark, SMALL)
    path = fresh_path(spark, "test-stream-restart")
    for _ in range(2):
        q = start_rollup_refresh(spark, source, path, f"{path}/_checkpoint", available_now=True)
        q.awaitTermination()
    total = serve(read_refreshed_rollup(spark, path), ["lives"], []).first()["lives"]
    direct = lives_summary(spark.read.parquet(source), ["lives"], []).first()["lives"]
    assert total == direct


def test_files_arriving_while_running(spark, lives_small):
    source = fresh_path(spark, "test-arrivals")
    early = lives_small.filter("date_year <= '1996'")
    late = lives_small.filter("date_year > '1996'")
    early.write.parquet(source)
    path = fresh_path(spark, "test-arrivals-rollup")
    q = start_rollup_refresh(spark, source, path, f"{path}/_checkpoint", every="1 second")
    try:
        q.processAllAvailable()
        first = serve(read_refreshed_rollup(spark, path), ["lives"], []).first()["lives"]
        assert first == lives_summary(early, ["lives"], []).first()["lives"]
        late.write.mode("append").parquet(source)
        q.processAllAvailable()
    finally:
        q.stop()
    total = serve(read_refreshed_rollup(spark, path), ["lives"], ["benefit_type"])
    direct = lives_summary(lives_small, ["lives"], ["benefit_type"])
    assert total.exceptAll(direct).count() == 0 and direct.exceptAll(total).count() == 0


def test_compaction_then_more_arrivals(spark, lives_small):
    source = fresh_path(spark, "test-compaction-src")
    years = sorted(r[0] for r in lives_small.select("date_year").distinct().collect())
    path = fresh_path(spark, "test-compaction")
    dims = ["payer_role", "geography_type"]
    for i, year in enumerate(years):
        lives_small.filter(lives_small.date_year == year).write.mode("append").parquet(source)
        q = start_rollup_refresh(spark, source, path, f"{path}/_checkpoint", available_now=True)
        q.awaitTermination()
        if i % 2 == 1:
            compact(spark, path)
        arrived = lives_small.filter(lives_small.date_year <= year)
        served = serve(read_refreshed_rollup(spark, path), ["lives", "pbm_rx_lives"], dims)
        direct = lives_summary(arrived, ["lives", "pbm_rx_lives"], dims)
        assert served.exceptAll(direct).count() == 0 and direct.exceptAll(served).count() == 0, year


def test_requests_served_from_a_stream_store(spark, lives_small):
    from covlens import lives_request

    source = lives_table_path(spark, SMALL)
    path = fresh_path(spark, "test-stream-serve")
    q = start_rollup_refresh(spark, source, path, f"{path}/_checkpoint", available_now=True, max_files_per_trigger=2)
    q.awaitTermination()
    dims = ["payer_category", "geography_type"]
    served = lives_request(lives_small, ["lives", "pbm_rx_lives"], dims, segments=["current_commercial"],
                           rollup_path=path)
    assert all("/parts/" in f for f in served.inputFiles())
    direct = lives_summary(lives_small, ["lives", "pbm_rx_lives"], dims, segments=["current_commercial"])
    assert served.exceptAll(direct).count() == 0 and direct.exceptAll(served).count() == 0
    compact(spark, path)
    again = lives_request(lives_small, ["lives", "pbm_rx_lives"], dims, segments=["current_commercial"],
                          rollup_path=path)
    assert again.exceptAll(direct).count() == 0 and direct.exceptAll(again).count() == 0


def test_unfinished_batch_is_not_seen_and_not_lost(spark, lives_small):
    """Compaction while a batch is half done: it is served, once, after its commit."""
    from covlens.streaming.refresh import commit_part, committed, write_part

    path = fresh_path(spark, "test-unfinished")
    years = sorted(r[0] for r in lives_small.select("date_year").distinct().collect())[:4]
    slices = [lives_small.filter(lives_small.date_year == y) for y in years]

    def total():
        return serve(read_refreshed_rollup(spark, path), ["lives"], []).first()["lives"]

    def direct(n):
        return lives_summary(lives_small.filter(lives_small.date_year.isin(years[:n])), ["lives"], []).first()["lives"]

    commit_part(spark, path, 0, write_part(slices[0], path, 0))
    open_part = write_part(slices[1], path, 1)  # written, not committed
    commit_part(spark, path, 2, write_part(slices[2], path, 2))
    compact(spark, path)
    assert set(committed(spark, path)) == {0, 2}
    commit_part(spark, path, 1, open_part)
    assert total() == direct(3)
    compact(spark, path)
    assert total() == direct(3)
    commit_part(spark, path, 3, write_part(slices[3], path, 3))
    compact(spark, path)  # retires what the compaction before it folded
    assert total() == direct(4) and set(committed(spark, path)) == {3}


def test_crash_between_data_and_stamp_keeps_the_version(spark, lives_small, monkeypatch):
    import pytest
    from covlens.operators import rollup

    path = fresh_path(spark, "test-stamp")
    rollup.build_rollup(lives_small.filter("date_year = '1995'"), path)
    before = rollup.current_version(spark, path)
    original = rollup._meta

    def broken(p):
        raise OSError("lost")

    monkeypatch.setattr(rollup, "_meta", broken)
    with pytest.raises(OSError):
        rollup.build_rollup(lives_small, path)
    monkeypatch.setattr(rollup, "_meta", original)
    assert rollup.current_version(spark, path) == before
    rollup.build_rollup(lives_small, path)
    assert rollup.current_version(spark, path)["data"] != before["data"]


def _arrive(spark, source, path, rows, **options):
    rows.write.mode("append").parquet(source)
    q = start_rollup_refresh(spark, source, path, f"{path}/_checkpoint", available_now=True, once=True, **options)
    q.awaitTermination()
    assert q.exception() is None
    return serve(read_refreshed_rollup(spark, path), ["lives"], []).first()["lives"]


def test_redelivered_rows_count_once_over_restarts(spark):
    """The same row in one batch, in a later batch and after a restart; restated and NULL-shifted rows are other rows."""
    from conftest import lives_rows

    source, path = fresh_path(spark, "test-again-src"), fresh_path(spark, "test-again")
    first = {"row_hashkey": "a", "date_id": "20240101", "load_time": "2024-01-15T00:00:00Z", "rx_lives": 10}
    old = {"row_hashkey": "b", "date_id": "19920101", "load_time": "1992-01-15T00:00:00Z", "rx_lives": 100}
    odd = [{"row_hashkey": "c", "zip": "", "rx_lives": 1000}, {"row_hashkey": "c", "zip": None, "rx_lives": 1000},
           {"row_hashkey": "c", "plan_id": "", "rx_lives": 1000}, {"row_hashkey": None, "rx_lives": None}]
    assert _arrive(spark, source, path, lives_rows(spark, [first, first])) == 10
    assert _arrive(spark, source, path, lives_rows(spark, [first, old])) == 110
    assert _arrive(spark, source, path, lives_rows(spark, [{**first, "rx_lives": 20}, old, *odd])) == 3130
    assert _arrive(spark, source, path, lives_rows(spark, odd)) == 3130
    compact(spark, path)
    assert _arrive(spark, source, path, lives_rows(spark, [old])) == 3130


def test_same_by_names_what_tells_a_row(spark):
    from conftest import lives_rows

    source, path = fresh_path(spark, "test-by-src"), fresh_path(spark, "test-by")
    rows = [{"row_hashkey": "a", "load_time": "1", "rx_lives": 10}, {"row_hashkey": "b", "load_time": "1", "rx_lives": 5}]
    again = [{**r, "load_time": "2"} for r in rows]
    assert _arrive(spark, source, path, lives_rows(spark, rows), same_by=["row_hashkey"]) == 15
    assert _arrive(spark, source, path, lives_rows(spark, again), same_by=["row_hashkey"]) == 15


def test_batch_replayed_after_its_commit_keeps_its_state(spark):
    """The mark was written, the checkpoint's own commit was lost: the batch runs again, counts nothing, remembers its rows."""
    import glob
    import os

    from conftest import lives_rows

    source, path = fresh_path(spark, "test-replay-src"), fresh_path(spark, "test-replay")
    rows = lives_rows(spark, [{"row_hashkey": "a", "rx_lives": 10}])
    assert _arrive(spark, source, path, rows) == 10
    folder = path.removeprefix("file:")
    marks = sorted(f for f in glob.glob(f"{folder}/_checkpoint/commits/*") if os.path.basename(f).isdigit())
    os.remove(marks[-1])
    crc = os.path.join(os.path.dirname(marks[-1]), f".{os.path.basename(marks[-1])}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert _arrive(spark, source, path, rows) == 10


def test_only_rollup_columns_cross_the_shuffle(spark):
    from covlens.plans.inspect import plan_text
    from covlens.streaming.refresh import without_redelivered
    from conftest import lives_rows

    stream = spark.readStream.schema(lives_rows(spark, []).schema).parquet(lives_table_path(spark, SMALL))
    kept = without_redelivered(stream)
    assert "payer_id" in kept.columns and "plan_name" not in kept.columns and "load_time" not in kept.columns
    assert "hashpartitioning(__row" in plan_text(kept, "simple")
