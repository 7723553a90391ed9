"""Loads merged into a stored fact: versions, untouched files, repeated and dying loads, against a plain replay."""

from __future__ import annotations

import random

import pytest
from covlens.operators import history as h
from covlens.operators.incremental import _manifest
from covlens.session import fresh_path

SCHEMA = "k string, month string, v long, load_time string"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _load(spark, path, rows, at, **options):
    return h.merge_load(spark, path, _df(spark, rows), at, key=["k", "month"], part="month", **options)


def _all(spark, path):
    return sorted((tuple(r) for r in h.read_history(spark, path, _df(spark, []).schema).collect()), key=str)


def _replay(loads, replaces):
    """Versions by a plain replay: [k, month, v, load_time, from, to]."""
    out = []
    for at, rows in loads:
        newest = {}
        for r in rows:
            if r[:2] not in newest or (r[3] or "") > (newest[r[:2]][3] or ""):
                newest[r[:2]] = r
        months = {r[1] for r in rows}
        for old in [o for o in out if o[5] is None and o[1] in months]:
            new = newest.get(tuple(old[:2]))
            if new is None:
                if replaces:
                    old[5] = at
            elif list(new) == old[:4]:
                del newest[tuple(old[:2])]
            else:
                old[5] = at
        out += [[*r, at, None] for r in newest.values()]
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("replaces", [False, True])
def test_against_a_replay(spark, replaces):
    rng, path, loads = random.Random(4), fresh_path(spark, "t"), []
    for n in range(4):
        months = rng.sample(["2024-01", "2024-02", "2024-03", None], 2)
        rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice(months), rng.choice([1, 2, None]), f"t{i}") for i in range(8)]
        loads.append((f"2026-0{n + 1}", rows))
        before = _manifest(spark, path)
        touched = _load(spark, path, rows, loads[-1][0], replaces=replaces)
        after = _manifest(spark, path)
        assert all(after[p] == before[p] for p in before if p not in touched)  # other months keep their files
    assert _all(spark, path) == _replay(loads, replaces)


def test_a_load_given_twice_and_as_of(spark):
    path, rows = fresh_path(spark, "t"), [("a", "2024-01", 1, "t"), ("b", "2024-01", 2, "t")]
    _load(spark, path, rows, "1")
    _load(spark, path, rows, "2")
    assert {(r[4], r[5]) for r in _all(spark, path)} == {("1", None)}
    _load(spark, path, [("a", "2024-01", 5, "t")], "3")
    history = h.read_history(spark, path, _df(spark, []).schema)
    assert sorted(r["v"] for r in h.as_of(history).collect()) == [2, 5]
    assert sorted(r["v"] for r in h.as_of(history, "2").collect()) == [1, 2]
    with pytest.raises(ValueError):
        _load(spark, path, rows, "3")
    assert _load(spark, path, [], "4") == []


def test_a_load_that_dies_changes_nothing(spark, monkeypatch):
    path = fresh_path(spark, "t")
    _load(spark, path, [("a", "2024-01", 1, "t")], "1")
    before = _all(spark, path)

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(h, "publish", dies)
        with pytest.raises(RuntimeError):
            _load(spark, path, [("a", "2024-01", 2, "t")], "2")
    assert _all(spark, path) == before


def test_whole_rows_cross_few_shuffles(spark, lives_small):
    """A first load without repeated keys deals its rows out once; a second one that changes few rows moves little more."""
    rows = lives_small.dropDuplicates(["row_hashkey", "date_id"])
    path, key = fresh_path(spark, "t"), ["row_hashkey", "date_id"]
    plans = []

    def newest(load, newest_by, columns, plain=h._newest):
        plans.append(plain(load, newest_by, columns))
        return plans[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(h, "_newest", newest)
        h.merge_load(spark, path, rows, "1", key=key, part="date_year")
    assert "Window" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    assert h.read_history(spark, path, rows.schema).count() == rows.count()


def test_narrow_rows_of_the_fact(spark):
    """What crosses the shuffles before the fact is written is narrower than the fact, and spells out to the same rows."""
    from covlens.sources import fixtures

    from conftest import SMALL

    narrow = fixtures._lives_rows(spark, SMALL)
    assert len(narrow.columns) < 25 and not {"row_hashkey", "mco_name", "payer_parent_name"} & set(narrow.columns)
    path = fresh_path(spark, "t")
    fixtures.write_lives(narrow, path)
    written = fixtures.lives_table(spark, SMALL)
    assert spark.read.schema(written.schema).parquet(path).select(*written.columns).exceptAll(fixtures.derive_lives(spark, SMALL)).isEmpty()
    fixtures.write_lives_by(spark, SMALL, f"{path}-zip", "zip")
    by_zip = spark.read.schema(written.schema).parquet(f"{path}-zip").select(*written.columns)
    assert by_zip.count() == written.count() and by_zip.exceptAll(written).isEmpty()


def test_lines_meet_orders_narrow_and_nations_are_named_after_the_last_shuffle(spark):
    """No line carries its order's, supplier's or nation's columns further than need be, and the files are packed tight."""
    from covlens.sources import fixtures

    from conftest import SMALL

    narrow = fixtures._lives_rows(spark, SMALL, named=False)
    assert not {"n_name", "r_name", "c_mktsegment", "o_orderstatus", "priority", "date_year"} & set(narrow.columns)
    joins = [line for line in narrow._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    order = [next(c for c in ("l_suppkey", "l_orderkey", "l_partkey") if c in j) for j in joins if "l_" in j]
    assert order == ["l_suppkey", "l_orderkey", "l_partkey"]  # the last join first
    path = fresh_path(spark, "t")
    fixtures.write_lives(narrow, path, fixtures._geo(spark, SMALL))
    written = fixtures.lives_table(spark, SMALL)
    again = spark.read.schema(written.schema).parquet(path)
    assert again.select(*written.columns).exceptAll(written).isEmpty() and again.count() == written.count()
    assert all(".zstd." in f for f in again.inputFiles())
