"""Merging loads into a stored fact that keeps its history.

Every row is valid from the load that brought it (``valid_from``) until the
load that changed or withdrew it (``valid_to``, NULL for the current one). The
fact is stored in period folders; a manifest names the folder of each period.
A load rewrites only the periods it has rows of (copy on write) and publishes
the new manifest by one stamp: other periods keep their files, readers see the
fact before or after a load, and a load that dies changes nothing.

In a touched period, current rows and the load meet by a digest of the key
(NULL a value like any other) and a hash of the content. That meeting is of
these alone; its outcome is written and sent to the rows as bitmaps (see
``membership``), so whole rows of the fact, and of a load that lies by period as a
stored fact does, are written by the tasks that read them. Only a load whose
periods are spread over its tasks is dealt out by period, once. A row whose content is the same stays as it is, so a load given
twice changes nothing. ``replaces=True`` takes the load for all there is of its
periods: current rows it lacks are closed. Rows that repeat a key within a load
are reduced to the newest by ``newest_by``, ties by the larger hash. The period
must follow from the key, as the month does.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import FREED, settings
from ..sources.fixtures import COMPRESSION
from ..sources.schemas import LIVES_KEY
from .incremental import _MANIFEST, _NO_VALUE, _manifest
from .membership import key_digest, levels_of, told, with_chosen
from .prepare import content_hash
from .rollup import current_version, publish

#: Files written for each task or period, up to which a load is written from where its rows are.
FILES = 4
#: Periods whose files one task keeps open at a time; the rows of further ones are sorted first.
WRITERS = 16

VALIDITY = [T.StructField("valid_from", T.StringType()), T.StructField("valid_to", T.StringType())]


def _newest(load: DataFrame, newest_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each key ``__k``. Only rows whose key's hash repeats are put in order; all others stay where they are."""
    counted = load.groupBy(F.xxhash64("__k").alias("__g")).agg(F.count(F.lit(1)).alias("n"))
    repeated = told(counted.filter("n > 1").select("__g"), "history-repeated")
    if repeated.isEmpty():
        return load
    load, last = load.withColumn("__g", F.xxhash64("__k")), [F.col(c).desc() for c in newest_by] + [content_hash(columns).desc()]
    nth = F.row_number().over(Window.partitionBy("__g", "__k").orderBy(*last))
    many = load.join(repeated, "__g", "left_semi").withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    return load.join(repeated, "__g", "left_anti").unionByName(many).drop("__g")


def _periods(load: DataFrame, named: Column) -> tuple[list[str], bool]:
    """The load's periods, in order, and whether they lie apart: its tasks hold few periods each."""
    held = load.select(named.alias("p"), F.spark_partition_id().alias("t")).distinct()
    rows = held.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t")).collect()  # a row for each period
    files, tasks = sum(r["n"] for r in rows), max((r["t"] + 1 for r in rows), default=0)
    return sorted(r["p"] for r in rows), files <= FILES * max(tasks, len(rows))


def _write_in_place(rows: DataFrame, path: str) -> None:
    """Write a folder for each ``__part`` from where the rows are, with no sort while a task meets few of them."""
    with settings(rows.sparkSession, {**FREED, "spark.sql.maxConcurrentOutputFileWriters": str(WRITERS)}):
        rows.write.partitionBy("__part").parquet(path, compression=COMPRESSION)


def read_history(spark: SparkSession, path: str, schema: T.StructType, parts: Sequence[str] | None = None) -> DataFrame:
    """All versions of all rows (or of some periods), with valid_from and valid_to; ``schema`` is the fact's."""
    full = T.StructType([*schema.fields, *VALIDITY])
    held = _manifest(spark, path)
    folders = [data for p, (data, _) in sorted(held.items()) if parts is None or p in parts]
    return spark.read.schema(full).parquet(*folders) if folders else spark.createDataFrame([], full)


def as_of(history: DataFrame, at: str | None = None) -> DataFrame:
    """The rows valid at a load (the last one by default), without their validity."""
    if at is None:
        rows = history.filter("valid_to is null")
    else:
        rows = history.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return rows.drop("valid_from", "valid_to")


def merge_load(
    spark: SparkSession, path: str, load: DataFrame, at: str, key: Sequence[str] = LIVES_KEY, part: str = "date_id",
    newest_by: Sequence[str] = ("load_time",), replaces: bool = False,
) -> list[str]:
    """Merge a load into the fact at ``path`` as of ``at`` (text that sorts by time); the periods rewritten, in order.

    ``at`` must be later than every load before it.
    """
    stamp = current_version(spark, path)
    held = _manifest(spark, path)
    if stamp is not None and any(at <= last for _, last in held.values()):
        raise ValueError(f"a load at {at} does not follow the loads before it")
    named = F.coalesce(F.col(part).cast("string"), F.lit(_NO_VALUE))
    touched, apart = _periods(load, named)
    if not touched:
        return []
    schema, names, content = load.schema, load.columns, [c for c in load.columns if c not in key]
    hashes = {"__k": key_digest(key), "__h": content_hash(content)}
    history = read_history(spark, path, schema, touched)
    current = history.filter("valid_to is null").withColumns(hashes)
    new = _newest(load.withColumns(hashes), newest_by, names)
    kept, came = current.withColumn("valid_to", F.lit(None).cast("string")), new
    if any(p in held for p in touched):
        none = F.lit(None).cast("long")
        both = current.select("__k", F.col("__h").alias("was"), none.alias("now"))
        both = both.unionByName(new.select("__k", none.alias("was"), F.col("__h").alias("now")))
        met = both.groupBy("__k").agg(F.max("was").alias("was"), F.max("now").alias("now"))
        # Changed, or new; without a row in the load (withdrawn) only if the load is all there is.
        changed = F.coalesce(F.col("was") != F.col("now"), F.col("now").isNotNull() | F.lit(replaces))
        levels = levels_of(told(met.select("__k", changed.alias("chosen")), "history-fates"), "history-changed")
        kept = with_chosen(current, levels).withColumn("valid_to", F.when(F.col("__chosen"), F.lit(at)))
        came = with_chosen(new, levels).filter("__chosen")
    kept = kept.select(*names, "valid_from", "valid_to")
    came = came.select(*names, F.lit(at).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    came = came.withColumn("__part", named)
    if not apart:
        came = came.hint("rebalance", "__part")
    stays = history.filter("valid_to is not null").unionByName(kept).withColumn("__part", named)
    rows = stays.unionByName(came) if any(p in held for p in touched) else came
    run = f"{path.rstrip('/')}/parts/{uuid.uuid4().hex}"
    _write_in_place(rows, run)
    manifest = [(p, *held[p]) for p in held if p not in touched] + [(p, f"{run}/__part={p}", at) for p in touched]
    publish(spark.createDataFrame(manifest, _MANIFEST).coalesce(1), path, layout=())
    return touched
