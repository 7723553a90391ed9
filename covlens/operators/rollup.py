"""The stored rollup: build, coverage test, serve, refresh.

The rollup holds the main measure and the benefit-manager lives, summed by 13
dimensions and written as Parquet. Each build writes a new version folder;
a stamp added beside it names the version and its build time, and
is written last, so a build that fails half-way (a lost executor that the
retries cannot cover, a killed job) leaves the previous version in service.
Older versions stay in place for readers that still hold them; the storage's
retention rules (for example, delete version folders older than a week)
remove them. Both measures are sums, so a coarser request is answered by
summing the stored sums (with the same NULL-for-nothing result as the fact).
It holds no month, plan, zip or count, and no multi-stage measure can use it;
such requests go to the fact (``on_miss="fact"``) or raise.

Layout: rows are sorted within files by book, current flag, source and
benefit type, the filters most requests carry, so Parquet row-group
statistics skip groups for them; rows stay in the tasks that read or group
them, so the write adds no shuffle, and groups of one row cross none at all.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.members import SEGMENT_COLUMNS
from .summary import lives_summary, request_filter, wide_summary

# The rollup's dimensions (selective first) and measures.
ROLLUP_DIMENSIONS: tuple[str, ...] = (
    "book_of_business",
    "flag_current_record",
    "lives_source",
    "benefit_type",
    "ecosystem_code",
    "ecosystem_name",
    "geography_type",
    "payer_category",
    "payer_id",
    "payer_name",
    "payer_role",
    "pbm_id",
    "pbm_name",
)
ROLLUP_MEASURES: tuple[str, ...] = ("lives", "pbm_rx_lives")
LAYOUT_COLUMNS: tuple[str, ...] = ROLLUP_DIMENSIONS[:4]
MAX_AGE = dt.timedelta(days=1)


def _meta(path: str) -> str:
    return f"{path.rstrip('/')}/meta"


_STAMP = "built_at string, data string, through_batch long, published_at string, fingerprint string"


def publish(rollup: DataFrame, path: str, built_at: dt.datetime | None = None,
            through_batch: int | None = None, fingerprint: str | None = None, layout: Sequence[str] = LAYOUT_COLUMNS) -> str:
    """Write rollup rows as a new version under ``path``, then make it the current one.

    The version becomes current by one stamp file added beside the earlier
    ones: a reader sees either the stamp or the one before it, and a crash in
    between leaves the earlier version in service. ``through_batch`` records
    the last refresh-stream batch folded in (see ``streaming.refresh.compact``),
    ``fingerprint`` the state of the source that the rows were made from
    (see ``operators.incremental``).
    """
    spark = rollup.sparkSession
    now = dt.datetime.now(dt.timezone.utc)
    built_at = (built_at or now).astimezone(dt.timezone.utc)
    version = f"{path.rstrip('/')}/data/v_{built_at.strftime('%Y%m%dT%H%M%S')}_{uuid.uuid4().hex[:8]}"
    (rollup.sortWithinPartitions(*layout) if layout else rollup).write.mode("errorifexists").parquet(version)
    stamp = [(built_at.isoformat(), version, through_batch, now.isoformat(timespec="microseconds"), fingerprint)]
    stamp = spark.createDataFrame(stamp, _STAMP)
    stamp.coalesce(1).write.mode("append").parquet(_meta(path))
    return path


def build_rollup(lives: DataFrame, path: str, built_at: dt.datetime | None = None) -> str:
    """Aggregate the whole fact to the rollup grain and publish it as a new version."""
    return publish(wide_summary(lives, ROLLUP_MEASURES, ROLLUP_DIMENSIONS), path, built_at)


def path_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def current_version(spark: SparkSession, path: str):
    """The published version's row (built_at, data, through_batch, published_at), or None: the newest stamp."""
    try:
        stamps = spark.read.schema(_STAMP).parquet(_meta(path))
    except AnalysisException as error:
        if path_missing(error):
            return None
        raise
    return stamps.orderBy(F.desc("published_at"), F.desc("data")).first()


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The published version of a stored rollup, or the rows of a refresh-stream store.

    A store kept by ``streaming.refresh`` (a compacted rollup plus the partial
    sums written after it) reads the same way, so every request path serves
    from either kind of store.
    """
    row = current_version(spark, path)
    if row is not None:
        return spark.read.parquet(row["data"])
    from ..streaming.refresh import read_refreshed_rollup

    try:
        return read_refreshed_rollup(spark, path)
    except FileNotFoundError:
        raise FileNotFoundError(f"no rollup at {path}") from None


def built_at(spark: SparkSession, path: str) -> dt.datetime | None:
    """Build time of the published rollup; None when there is none."""
    row = current_version(spark, path)
    return dt.datetime.fromisoformat(row["built_at"]) if row else None


def _on_dimensions(spark: SparkSession, where: Column) -> bool:
    """Whether a condition reads nothing but the stored dimensions."""
    empty = spark.createDataFrame([], ", ".join(f"{d} string" for d in ROLLUP_DIMENSIONS))
    try:
        empty.filter(where).schema
    except AnalysisException:
        return False
    return True


def covers(
    measures: Sequence[str],
    dimensions: Sequence[str],
    segments: Iterable[str] = (),
    where: Column | None = None,
    spark: SparkSession | None = None,
    path: str | None = None,
) -> bool:
    """Whether the rollup can answer a request.

    Measures within the stored sums, dimensions and named filters within the
    stored dimensions. A free ``where`` Column is resolved against an empty
    frame that holds only the stored dimensions (needs ``spark``), so a
    condition on a measure is never taken for one on its stored sums.
    ``path``, if given, must hold a rollup.
    """
    if any(m not in ROLLUP_MEASURES for m in measures) or not (measures or dimensions):
        return False
    if any(d not in ROLLUP_DIMENSIONS for d in dimensions):
        return False
    for s in segments:
        if any(c not in ROLLUP_DIMENSIONS for c in SEGMENT_COLUMNS[s]):
            return False
    if where is not None and (spark is None or not _on_dimensions(spark, where)):
        return False
    if spark is not None and path is not None:
        try:
            read_rollup(spark, path)
        except FileNotFoundError:
            return False
    return True


def serve(rollup: DataFrame, measures: Sequence[str], dimensions: Sequence[str],
          where: Column | None = None, segments: Iterable[str] = ()) -> DataFrame:
    """Answer an additive request by summing the stored sums (U2); without measures, the distinct dimension values."""
    cond = request_filter(where, segments)
    base = rollup if cond is None else rollup.filter(cond)
    if not measures:
        return base.select(*dimensions).distinct()
    sums = [F.sum(F.col(m)).alias(m) for m in measures]
    return base.groupBy(*dimensions).agg(*sums) if dimensions else base.agg(*sums)


def is_fresh(spark: SparkSession, path: str, max_age: dt.timedelta, now: dt.datetime | None = None) -> bool:
    """Whether the rollup at ``path`` was built within ``max_age``; a stream store not yet compacted is fresh."""
    from ..streaming.refresh import compacted

    stamp = built_at(spark, path) or built_at(spark, compacted(path))
    return stamp is None or (now or dt.datetime.now(dt.timezone.utc)) - stamp <= max_age


def lives_from_rollup(
    spark: SparkSession,
    path: str,
    lives: DataFrame | None,
    measures: Sequence[str] = ("lives",),
    dimensions: Sequence[str] = (),
    where: Column | None = None,
    segments: Iterable[str] = (),
    on_miss: str = "fact",
    max_age: dt.timedelta | None = None,
    **fact_options,
) -> DataFrame:
    """A request served from the rollup when it covers it, else from the fact.

    With ``max_age``, a rollup built longer ago is passed over. Further
    options go to ``lives_summary`` when the fact answers.
    """
    segments = list(segments)
    if covers(measures, dimensions, segments, where, spark, path) and (max_age is None or is_fresh(spark, path, max_age)):
        return serve(read_rollup(spark, path), measures, dimensions, where, segments)
    if on_miss == "error" or lives is None:
        raise ValueError("the rollup does not cover this request")
    return lives_summary(lives, measures, dimensions, where=where, segments=segments, **fact_options)


def refresh_rollup(
    lives: DataFrame,
    path: str,
    max_age: dt.timedelta = MAX_AGE,
    now: dt.datetime | None = None,
) -> bool:
    """Rebuild the rollup when it is missing or older than ``max_age`` (U4). True when rebuilt."""
    spark = lives.sparkSession
    now = now or dt.datetime.now(dt.timezone.utc)
    stamp = built_at(spark, path)
    if stamp is not None and now - stamp <= max_age:
        return False
    build_rollup(lives, path, built_at=now)
    return True

