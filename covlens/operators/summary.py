"""Additive requests: measures by any set of dimensions.

One request is one ``filter`` and one ``groupBy().agg()``: Catalyst pushes the
filter into the Parquet scan, prunes the columns, and plans a partial
(map-side) aggregation, one shuffle on the grouping key and a final
aggregation. Nothing leaves the JVM.

Lives are a monthly snapshot that the model declares additive: a request that
spans several months, or history rows (``flag_current_record = 'N'``), counts
the same people more than once; national rows (NULL ecosystem) and ecosystem
rows share the table, so an unfiltered total mixes the two levels. Filter with
``segments=("current_commercial",)`` / ``("ecosystem_level",)`` or a month as
the question requires.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.members import (
    CONFIG_DIMENSION_NAMES,
    DERIVED_DIMENSIONS,
    DIMENSION_NAMES,
    all_of,
    default_filter,
    dimension,
    measure,
    row_measure,
    segment_filter,
)
from ..session import FREED, fresh_path, settings

#: Keys that repeat, up to which their rows are told apart by a broadcast of the keys' 64-bit hashes (8 MB).
REPEATED_KEYS = 1 << 20


def request_filter(where: Column | None = None, segments: Iterable[str] = (), defaults: bool = False) -> Column | None:
    """The caller's filter, the named filters and (on request) the default filters, all must hold."""
    return all_of([where, segment_filter(segments), default_filter() if defaults else None])


def filtered(df: DataFrame, where: Column | None = None, segments: Iterable[str] = (), defaults: bool = False) -> DataFrame:
    """The rows on which every condition holds; ``where`` may name the derived dimensions too."""
    cond = request_filter(where, segments, defaults)
    if cond is None:
        return df
    named = {d: dimension(d) for d in DERIVED_DIMENSIONS if d not in df.columns} if where is not None else {}
    return df.withColumns(named).filter(cond).drop(*named) if named else df.filter(cond)


def filtered_with_hierarchy(
    df: DataFrame, where: Column | None, segments: Iterable[str], defaults: bool, hierarchy: DataFrame | None,
    match: str = "both", check: bool = True,
) -> tuple[DataFrame, bool]:
    """(filtered rows, whether they carry the hierarchy's columns).

    The hierarchy is joined to the rows only when ``where`` does not resolve
    without it.
    """
    if where is not None and hierarchy is not None:
        try:
            return filtered(df, where, segments, defaults), False
        except AnalysisException:
            from .hierarchy import with_hierarchy

            return filtered(with_hierarchy(df, hierarchy, match, check), where, segments, defaults), True
    return filtered(df, where, segments, defaults), False


def _join_key(match: str) -> Column:
    """The fact's side of the hierarchy join as one column."""
    if match == "both":
        return F.when(F.col("plan_id") == F.col("payer_id"), F.col("plan_id"))
    if match == "plan":
        return F.col("plan_id")
    if match == "payer":
        return F.col("payer_id")
    raise ValueError("match must be 'both', 'plan' or 'payer'")


def _split_dimensions(dimensions: Sequence[str], hierarchy: DataFrame | None):
    own, joined = [], []
    for d in dimensions:
        if d in DIMENSION_NAMES:
            own.append(d)
        elif hierarchy is not None and d in hierarchy.columns:
            joined.append(d)
        else:
            raise KeyError(f"unknown dimension {d!r}")
    return own, joined


def split_groups(base: DataFrame, measures: Sequence[str], dimensions: Sequence[str],
                 same: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Measures by dimensions in two frames: groups of a single row, and all other groups.

    For requests nearly as wide as the fact. A first pass counts the 64-bit
    hashes of the keys and stores those that repeat. A row whose hash does not
    repeat is a group of its own and stays where it is; only the others are
    shuffled and grouped, by the dimensions themselves, so two keys of one hash
    stay two groups. Where more than ``REPEATED_KEYS`` repeat, all rows are
    grouped (no first frame). Rows equal in ``same``, which must tell the
    dimensions, count once.
    """
    from .prepare import content_hash

    spark, dims = base.sparkSession, list(dimensions)
    rows = base.withColumns({d: dimension(d) for d in dims if d in DERIVED_DIMENSIONS})

    def grouped(some: DataFrame) -> DataFrame:
        return (some.dropDuplicates([same]) if same else some).groupBy(*dims).agg(*[measure(m) for m in measures])

    every = grouped(rows)
    hashed, path = rows.withColumn("__h", content_hash(dims)), fresh_path(spark, "repeated")
    with settings(spark, FREED):
        hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__h").write.parquet(path)
    repeated = spark.read.schema("__h long").parquet(path)
    known = repeated.count()
    if known > REPEATED_KEYS:
        return None, every
    single, many = hashed, every.limit(0)
    if known:
        single = hashed.join(F.broadcast(repeated), "__h", "left_anti")
        many = grouped(hashed.join(F.broadcast(repeated), "__h", "left_semi"))
    return single.select(*dims, *[row_measure(m).cast(every.schema[m].dataType).alias(m) for m in measures]), many


def wide_summary(base: DataFrame, measures: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """The rows of ``split_groups`` in one frame."""
    single, many = split_groups(base, measures, dimensions)
    return many if single is None else single.unionByName(many)


def lives_summary(
    df: DataFrame,
    measures: Sequence[str] = ("lives",),
    dimensions: Sequence[str] = (),
    where: Column | None = None,
    segments: Iterable[str] = (),
    defaults: bool = False,
    hierarchy: DataFrame | None = None,
    hierarchy_match: str = "both",
    check_hierarchy: bool = True,
    wide: bool = False,
) -> DataFrame:
    """Measures grouped by dimensions over the filtered lives fact.

    ``where`` is any boolean Column (the filter group and caller filters),
    ``segments`` names filters that must all hold, ``defaults`` adds the
    model's default filter values. A dimension of ``hierarchy`` (other than
    its key) makes the many-to-one join; without one no join is made. The
    measures are then summed before the join, to the request's own dimensions
    and one join key (NULL where no match is possible), so the join sees one
    row per such group rather than one per fact row. ``where`` may read any
    member: fact columns, derived dimensions by name, and the hierarchy's
    columns, which then are joined before the filter. A repeated hierarchy key
    fails the query; ``check_hierarchy=False`` leaves that test out for a
    hierarchy already checked with ``check_many_to_one``. With no measure the
    result is the distinct dimension values. ``wide=True`` tells that most groups
    hold one row: these are not shuffled (see ``split_groups``), at the price of
    a job over the keys' hashes when the plan is built.
    """
    own, joined = _split_dimensions(list(dimensions), hierarchy)
    base, carried = filtered_with_hierarchy(df, where, segments, defaults, hierarchy, hierarchy_match, check_hierarchy)
    if joined and not carried:
        # The fact is reduced first (map-side) to the request's own keys plus
        # one join key: sums and counts of the measures, or the distinct keys;
        # only that frame meets the hierarchy, and sums of sums finish it. With
        # the model's two-key condition a row can match only where plan id =
        # payer id; other rows get a NULL key (never equal to anything) and
        # collapse into one group per own-key value.
        from ..sources.schemas import HIERARCHY_KEY
        from .hierarchy import unique_hierarchy

        pre = base.groupBy(*[dimension(d) for d in own], _join_key(hierarchy_match).alias("__hkey"))
        pre = pre.agg(*[measure(m) for m in measures]) if measures else pre.agg(F.lit(1).alias("__any")).drop("__any")
        clash = [c for c in hierarchy.columns if c in pre.columns]
        if clash:
            raise ValueError(f"hierarchy columns clash with the request: {clash}")
        if check_hierarchy:
            hierarchy = unique_hierarchy(hierarchy)
        met = pre.join(hierarchy, pre["__hkey"] == hierarchy[HIERARCHY_KEY], "left")
        if not measures:
            return met.select(*own, *joined).distinct()
        return met.groupBy(*own, *joined).agg(*[F.sum(F.col(m)).alias(m) for m in measures])
    keys = [dimension(d) for d in own] + [F.col(d) for d in joined]
    if not measures:
        if not keys:
            raise ValueError("a request needs a measure or a dimension")
        return base.select(*keys).distinct()
    if wide and own and not joined:
        return wide_summary(base, measures, own)
    aggs = [measure(m) for m in measures]
    return base.groupBy(*keys).agg(*aggs) if keys else base.agg(*aggs)


def config_count(config: DataFrame, dimensions: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Row count of the benefit-type configuration, optionally by its dimensions."""
    for d in dimensions:
        if d not in CONFIG_DIMENSION_NAMES:
            raise KeyError(f"unknown configuration dimension {d!r}")
    base = config if where is None else config.filter(where)
    count = F.count(F.lit(1)).alias("record_count")
    return base.groupBy(*dimensions).agg(count) if dimensions else base.agg(count)
