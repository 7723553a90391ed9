"""A hot key holding about a third of the rows: results against brute force, and AQE splitting it."""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import functions as F

from covlens.operators.prepare import CURRENT_GRAIN, current_flag, dedup
from covlens.operators.shares import lives_shares
from covlens.plans.inspect import plan_text



def hot():
    """md5 hex keys starting with 0-4: 5/16 of the rows."""
    return F.col("row_hashkey") < "5"


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def hot_lives(lives):
    out = lives
    for c in CURRENT_GRAIN:
        out = out.withColumn(c, F.when(hot(), F.lit(None if c == "ecosystem_code" else "HOT")).otherwise(F.col(c)))
    return out


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_current_flag_with_hot_group(spark, lives_medium):
    df = hot_lives(lives_medium).select("row_hashkey", "date_id", "load_time", *CURRENT_GRAIN)
    with conf(spark, SKEW):
        out = current_flag(df)
        got = {r["row_hashkey"] + r["date_id"]: r["flag_current_record"] for r in out.collect()}
        plan = plan_text(out, "simple", executed=True)
    assert "skew=true" in plan
    pdf = df.toPandas()
    key = pdf[list(CURRENT_GRAIN)].fillna("<NULL>").astype(str).agg("|".join, axis=1)
    stamp = pdf["date_id"] + "|" + pdf["load_time"]
    latest = stamp.groupby(key).transform("max")
    expected = dict(zip(pdf["row_hashkey"] + pdf["date_id"], (stamp == latest).map({True: "Y", False: "N"})))
    assert got == expected
    assert sum(v == "Y" for v in got.values()) < len(got)


def test_dedup_with_hot_key(spark, lives_medium):
    df = lives_medium.withColumn("row_hashkey", F.when(hot(), F.lit("HOT")).otherwise(F.col("row_hashkey")))
    df = df.select("row_hashkey", "load_time", "plan_id")
    out = dedup(df, "row_hashkey", newest_by=["load_time", "plan_id"])
    hot_rows = out.filter(F.col("row_hashkey") == "HOT").collect()
    pdf = df.filter(F.col("row_hashkey") == "HOT").toPandas()
    newest = pdf.sort_values(["load_time", "plan_id"]).iloc[-1]
    assert len(hot_rows) == 1 and (hot_rows[0]["load_time"], hot_rows[0]["plan_id"]) == (newest["load_time"], newest["plan_id"])
    assert out.count() == df.select("row_hashkey").distinct().count()


def test_shares_with_hot_ecosystem(spark, lives_medium):
    df = lives_medium.withColumn("ecosystem_code", F.when(hot(), F.lit("ECOHOT")).otherwise(F.col("ecosystem_code")))
    dims = ["ecosystem_code", "benefit_type", "date_year_month", "payer_id"]
    with conf(spark, SKEW):
        a = lives_shares(df, ["pct_ecosystem_lives", "pct_national_lives"], dims, include_hidden=True)
        rows = a.collect()
    pdf = df.select(*dims, F.coalesce("rx_lives", "mx_lives").alias("v")).toPandas().fillna({"ecosystem_code": "<NULL>"})
    agg = pdf.groupby(dims, dropna=False)["v"].sum(min_count=1).reset_index()
    eco = agg.groupby(["ecosystem_code", "benefit_type", "date_year_month"])["v"].transform("sum")
    expected = dict(zip(agg[dims].astype(str).agg("|".join, axis=1), eco))
    got = {"|".join("<NULL>" if r[c] is None else str(r[c]) for c in dims): r["ecosystem_total_lives"] for r in rows}
    assert len(got) == len(expected)
    assert all(pd.isna(expected[k]) and v is None or expected[k] == v for k, v in got.items())
