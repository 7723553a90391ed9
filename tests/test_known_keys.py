"""Keys of a load against all loads before it: filters may ask too much, never too little."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from covlens.operators import known_keys as k
from covlens.plans.inspect import read_schemas
from covlens.session import fresh_path

SCHEMA = "a string, b string, month string, load string"


def _brute(loads, new):
    out = {}
    for r in new:
        out.setdefault(r[:2], [0, 0])[0] += 1
    for r in [r for rows in loads for r in rows]:
        if r[:2] in out:
            out[r[:2]][1] += 1
    return sorted(((*key, *n) for key, n in out.items() if n[0] > 1 or n[1] > 0), key=str)


def _repeats(spark, path, loads, new, scratch=None):
    history = spark.createDataFrame([r for rows in loads for r in rows], SCHEMA)
    found = k.repeats_of_load(spark, path, history, spark.createDataFrame(new, SCHEMA), ["a", "b"], "month", scratch)
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("expected", [1, 4096])
def test_against_brute_force(spark, expected):
    """Also with a filter far too small for its keys: more candidates, the same result."""
    rng, path = random.Random(5), fresh_path(spark, "t-keys")

    def rows(n):
        return [(rng.choice([None, "", "x", str(rng.randrange(60))]), rng.choice([None, "", "1", "2"]),
                 rng.choice(["2024-01", "2024-02", None]), rng.choice(["u", None])) for _ in range(n)]

    loads = [rows(60), rows(40)]
    for i, part in enumerate(loads):
        assert k.add_keys(spark.createDataFrame(part, SCHEMA), path, f"l{i}", ["a", "b"], "month", expected=expected)
    assert not k.add_keys(spark.createDataFrame(loads[0], SCHEMA), path, "l0", ["a", "b"], "month")
    new = rows(50)
    assert _repeats(spark, path, loads, new) == _brute(loads, new) != []
    assert _repeats(spark, path, loads, new, fresh_path(spark, "t-scratch")) == _brute(loads, new)
    assert (k.fill(spark, path) > 0.5) == (expected == 1)


def test_empty_store_empty_load_and_one_hot_key(spark):
    path = fresh_path(spark, "t-keys-empty")
    hot = [("h", None, "2024-01", None)] * 500 + [("c", "1", "2024-01", None)]
    assert k.fill(spark, path) == 0.0
    assert _repeats(spark, path, [], hot) == [("h", None, 500, 0)]
    assert k.add_keys(spark.createDataFrame([], SCHEMA), path, "none", ["a", "b"], "month", expected=64)
    assert _repeats(spark, path, [], hot) == [("h", None, 500, 0)]
    assert k.add_keys(spark.createDataFrame(hot, SCHEMA), path, "hot", ["a", "b"], "month")
    assert _repeats(spark, path, [hot], []) == []
    assert _repeats(spark, path, [hot], [("h", None, "2024-02", None)]) == [("h", None, 1, 500)]


def test_few_new_keys_are_candidates(spark):
    path = fresh_path(spark, "t-keys-rate")
    old = spark.range(20_000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 5).cast("string").alias("month"))
    k.add_keys(old, path, "old", ["a"], "month", expected=20_000)
    new = spark.range(20_000, 40_000).select(F.col("id").cast("string").alias("a"))
    assert k.maybe_known(spark, path, new, ["a"]).select("a").distinct().count() < 200  # under 1 %
    assert k.maybe_known(spark, path, old.select("a"), ["a"]).select("a").distinct().count() == 20_000


def test_only_the_key_of_touched_periods_is_read(spark, lives_small):
    """History is stored in year folders: a load that repeats rows of one year reads that year's key column alone."""
    path, stored = fresh_path(spark, "t-keys-plan"), fresh_path(spark, "t-keys-history")
    old = lives_small.filter("date_year <= '1998'")
    old.write.partitionBy("date_year").parquet(stored)
    k.add_keys(old, path, "old", ["row_hashkey"], "date_year", expected=10_000)
    load = spark.createDataFrame([(r["row_hashkey"], "2030") for r in old.filter("date_year = '1996'").limit(5).collect()],
                                 "row_hashkey string, date_year string")
    found = k.repeats_of_load(spark, path, spark.read.parquet(stored), load, ["row_hashkey"], "date_year",
                              scratch=fresh_path(spark, "t-keys-scratch"))
    assert found.count() == 5
    read = [s for s in read_schemas(found) if "row_hashkey" in s]
    assert read and all("payer_id" not in s and "rx_lives" not in s for s in read)
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        found.explain("formatted")
    assert "1996" in [line for line in text.getvalue().splitlines() if "PartitionFilters" in line and "date_year" in line][0]
    assert "1995" not in text.getvalue()


def test_keys_of_a_load_cross_the_shuffles_as_hashes(spark, lives_small):
    """Only rows whose hash repeats or is held are grouped by the key: the rest of the load crosses as 64-bit hashes."""
    path, key = fresh_path(spark, "t"), ["payer_id", "plan_id", "date_id"]
    k.add_keys(lives_small.filter("date_year <= '1996'"), path, "1", key, "date_year", expected=1 << 16)
    load = lives_small.filter("date_year > '1996'")
    out = k.repeats_of_load(spark, path, lives_small.filter("date_year <= '1996'"), load, key, "date_year", scratch=fresh_path(spark, "t"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [payer_id") < plan.index("bit_or(")  # a bitmap goes ahead of the rows
    plain = load.groupBy(*key).count().filter("count > 1")
    assert out.filter("in_load > 1").count() == plain.count()
