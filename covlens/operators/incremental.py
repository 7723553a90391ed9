"""Refresh by what changed in the source, not by its age.

The state of a source is told from its file listing alone: path, size and
modification time of every file, read through Spark's ``binaryFile`` source
without the files' contents. The listing is aggregated on the executors, so
only one row (or one for each period folder) reaches the driver.

``refresh_on_change`` rebuilds a stored result only when that state differs
from the one its stamp holds, however old the result is. ``refresh_changed_parts``
keeps the rollup in parts, one for each period folder of the fact, and a
manifest that names each part's folder and the state it was made from: only
folders whose files changed are read and aggregated anew, parts of folders that
are gone are left out, and the new manifest is published by one stamp. A run
that dies before its stamp leaves the earlier manifest, and every folder it
names, in service.

A source without files has the state of no files; files that a writer leaves
unfinished (under ``_temporary`` or hidden) do not count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import read_lives
from .rollup import ROLLUP_DIMENSIONS, ROLLUP_MEASURES, current_version, path_missing, publish
from .summary import split_groups

#: The folder of rows without a period.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_MANIFEST = "part string, data string, fingerprint string"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of the Parquet files under a folder, or of one file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return reader.load(path).select("path", "length", "modificationTime")


def _state() -> Column:
    """The state of a group of files: their number and the sum of their hashes, whatever their order."""
    total = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(total.cast("string"), F.lit("0")))


def fingerprint(spark: SparkSession, path: str) -> str:
    """The state of all files under a path; that of no files if there is no such path."""
    try:
        return listing(spark, path).agg(_state().alias("state")).first()["state"]
    except AnalysisException as error:
        if path_missing(error):
            return "0:0"
        raise


def refresh_on_change(spark: SparkSession, source: str, path: str, build: Callable[[SparkSession, str], DataFrame]) -> bool:
    """Publish ``build(spark, source)`` under ``path`` if the source's files changed since; True when it did.

    The state is taken before the rows are read: files that come in between
    make the next refresh rebuild, and no change is missed.
    """
    state = fingerprint(spark, source)
    row = current_version(spark, path)
    if row is not None and row["fingerprint"] == state:
        return False
    publish(build(spark, source), path, fingerprint=state, layout=())
    return True


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``refresh_on_change`` published last."""
    row = current_version(spark, path)
    if row is None:
        raise FileNotFoundError(f"nothing published at {path}")
    return spark.read.parquet(row["data"])


def part_states(spark: SparkSession, source: str, part: str) -> dict[str, str]:
    """The state of each period folder ``part=...`` of the fact."""
    try:
        files = listing(spark, source)
    except AnalysisException as error:
        if path_missing(error):
            return {}
        raise
    name = F.regexp_extract("path", f"/{part}=([^/]+)/", 1)
    rows = files.groupBy(name.alias("part")).agg(_state().alias("state")).collect()  # a row for each period
    if any(not r["part"] for r in rows):
        raise ValueError(f"files of {source} lie outside the folders {part}=...")
    return {r["part"]: r["state"] for r in rows}


def _manifest(spark: SparkSession, path: str) -> dict[str, tuple[str, str]]:
    row = current_version(spark, path)
    rows = [] if row is None else spark.read.schema(_MANIFEST).parquet(row["data"]).collect()
    return {r["part"]: (r["data"], r["fingerprint"]) for r in rows}


def _filled(spark: SparkSession, run: str, part: str) -> set[str]:
    """The period folders that a run wrote: a folder of files without rows has none."""
    rows = spark.read.schema(f"{part} string, lives long").parquet(run).select(part).distinct().collect()
    return {_NO_VALUE if r[part] is None else r[part] for r in rows}


def refresh_changed_parts(spark: SparkSession, source: str, path: str, part: str = "date_id") -> list[str]:
    """Bring a rollup kept by period folders up to date; the folders that were read, in order.

    All changed folders are aggregated in one job, whose scan is pruned to
    them, and written side by side under a folder of this run.
    """
    states, before = part_states(spark, source, part), _manifest(spark, path)
    changed = sorted(p for p, state in states.items() if before.get(p, ("", None))[1] != state)
    if not changed and set(before) == set(states):
        return []
    run = f"{path.rstrip('/')}/parts/{uuid.uuid4().hex}"
    if changed:
        wanted = F.col(part).isin(changed)
        lives = read_lives(spark, source, wanted | F.col(part).isNull() if _NO_VALUE in changed else wanted)
        single, rows = split_groups(lives, ROLLUP_MEASURES, [part, *ROLLUP_DIMENSIONS])
        rows = rows.hint("rebalance", part)  # groups of one row lie by period already, as the source does
        rows = rows if single is None else single.unionByName(rows)
        rows.sortWithinPartitions(part, *ROLLUP_DIMENSIONS[:4]).write.partitionBy(part).parquet(run)
    filled = _filled(spark, run, part) if changed else set()
    kept = [(p, *before[p]) for p in states if p not in changed]
    manifest = [*kept, *((p, f"{run}/{part}={p}" if p in filled else None, states[p]) for p in changed)]
    publish(spark.createDataFrame(manifest, _MANIFEST).coalesce(1), path, layout=())
    return changed


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The rollup's rows over all current parts, to be served like any rollup (sums add up over parts)."""
    if current_version(spark, path) is None:
        raise FileNotFoundError(f"no rollup at {path}")
    schema = ", ".join([*(f"{d} string" for d in ROLLUP_DIMENSIONS), *(f"{m} long" for m in ROLLUP_MEASURES)])
    folders = [data for data, _ in _manifest(spark, path).values() if data is not None]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
