"""Preparing the fact table's derived columns.

The model receives these columns ready-made; its descriptions state how they
are formed. Each job is a plain DataFrame transformation: built-in
expressions, joins whose strategy the planner picks by measured size, and
aggregations with map-side combine. None needs a Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import LIVES_KEY, LIVES_TEXT_COLUMNS

# --------------------------------------------------------------- T1 calendar


def calendar_columns(date: Column) -> dict[str, Column]:
    """Month start (YYYYMMDD), month (YYYY-MM), quarter (YYYY-QN) and year (YYYY) texts of a date."""
    d = F.to_date(date)
    year = F.date_format(d, "yyyy")
    return {
        "date_id": F.date_format(F.trunc(d, "month"), "yyyyMMdd"),
        "date_year_month": F.date_format(d, "yyyy-MM"),
        "date_year_quarter": F.concat(year, F.lit("-Q"), F.quarter(d).cast("string")),
        "date_year": year,
    }


def with_calendar(df: DataFrame, date_col: str) -> DataFrame:
    return df.withColumns(calendar_columns(F.col(date_col)))


# ------------------------------------------------------------- T2 zip lookup

ZIP_COLUMNS = ("ecosystem_code", "ecosystem_name", "state_code")


def apply_zip_lookup(df: DataFrame, zips: DataFrame, zip_col: str = "zip") -> DataFrame:
    """Ecosystem code and name and state from the zip table (LEFT: NULL where unmatched).

    The zip table must have one row per zip: the plan groups it by zip and
    raises, as it runs, where a zip has more, so the fact is never multiplied.
    No broadcast hint, the planner broadcasts the lookup when its measured
    size allows and shuffles otherwise.
    """
    grouped = zips.groupBy(F.col("zip").alias("__zip")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.max(c).alias(c) for c in ZIP_COLUMNS]
    )
    repeated = F.raise_error(F.concat(F.lit("zip table is not unique: "), F.col("__zip")))
    lookup = grouped.filter(F.col("__zip").isNotNull()).select(
        "__zip", *[F.when(F.col("__n") > 1, repeated).otherwise(F.col(c)).alias(c) for c in ZIP_COLUMNS]
    )
    base = df.drop(*[c for c in ZIP_COLUMNS if c in df.columns])
    return base.join(lookup, base[zip_col] == lookup["__zip"], "left").drop("__zip")


# ------------------------------------------------------------ T3 MCO name


def mco_name(payer_name: Column, category: Column) -> Column:
    """Payer name with its category in brackets; NULL when either part is NULL."""
    return F.concat(payer_name, F.lit(" ("), category, F.lit(")"))


# ------------------------------------------------------------ T4 hash key

HASH_COLUMNS: tuple[str, ...] = tuple(c for c in LIVES_TEXT_COLUMNS if c not in ("row_hashkey", "load_time"))


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 over the columns written as one JSON array of texts.

    JSON quotes and escapes each value, so no separator inside a value can
    shift a boundary, and NULL (``null``) differs from the empty text
    (``""``). One generator call per row keeps it inside generated code and
    about three times cheaper than assembling a length-prefixed string.
    """
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)


def with_row_hash(df: DataFrame, columns: Sequence[str] = HASH_COLUMNS, name: str = "row_hashkey") -> DataFrame:
    return df.withColumn(name, row_hash(columns))


# ------------------------------------------------------ T5 change detection


def content_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of a row's content for comparing two versions of the same key.

    ``xxhash64`` skips NULL inputs, so the NULL pattern is hashed as well: a
    value moved from one column to the next changes the hash. Only rows with
    the same key are compared, so a false "same" needs a 64-bit collision
    between a row's two versions.
    """
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])



def detect_changes(previous: DataFrame, current: DataFrame, key: str = "row_hashkey",
                   content: Sequence[str] | None = None, newest_by: Sequence[str] | None = None) -> DataFrame:
    """Insert, update, delete or same per key between two loads.

    Both loads are reduced to (key, content hash, side, order), stacked, and
    grouped by key: one shuffle of small rows, combined map-side, instead of a
    full outer join, whose skewed keys AQE cannot split. A key repeated within
    a load is compared by its newest row by ``newest_by`` (``max_by``; of rows
    that tie, the one with the largest hash), or by its largest hash when no
    order is given.
    """
    cols = list(content) if content is not None else [c for c in previous.columns if c != key]
    order = F.struct(*newest_by, content_hash(cols).alias("__tie")) if newest_by else F.lit(None).cast("int")

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(F.col(key), content_hash(cols).alias("__h"), F.lit(n).alias("__side"), order.alias("__o"))

    def version(n: int) -> Column:
        h = F.when(F.col("__side") == n, F.col("__h"))
        if newest_by:
            return F.max_by(h, F.when(F.col("__side") == n, F.col("__o")))
        return F.max(h)

    per_key = side(previous, 1).unionByName(side(current, 2)).groupBy(key).agg(
        version(1).alias("__old"),
        version(2).alias("__new"),
        F.bool_or(F.col("__side") == 1).alias("__in_old"),
        F.bool_or(F.col("__side") == 2).alias("__in_new"),
    )
    change = (
        F.when(~F.col("__in_old"), F.lit("insert"))
        .when(~F.col("__in_new"), F.lit("delete"))
        .when(F.col("__old") == F.col("__new"), F.lit("same"))
        .otherwise(F.lit("update"))
    )
    return per_key.select(F.col(key), change.alias("change"))


# ------------------------------------------------------ T6 current-record flag

CURRENT_GRAIN: tuple[str, ...] = tuple(c for c in LIVES_KEY if c != "date_id")


def current_flag(df: DataFrame, grain: Sequence[str] = CURRENT_GRAIN,
                 order: Sequence[str] = ("date_id", "load_time"), name: str = "flag_current_record") -> DataFrame:
    """'Y' on the latest record of each group of the lowest grain (by month, then load time), else 'N'.

    Rows tied on the latest (month, load time), possible only when the
    composite key repeats, are all flagged 'Y', deterministically; a
    ``row_number`` would pick one of them at random.

    The latest (month, load time) per group is an aggregation with map-side
    combine; a join brings it back. Group and join use one narrow key, 16 bytes
    of digest of the grain as a JSON array of texts, instead of nine columns. The
    key is declared nullable, though it never is NULL, and joined NULL-safe:
    both join sides are then shuffle stages of their own, so AQE can split a
    hot group's partition (tested with a third of the rows in one group); a
    window over the group, or a join reusing the aggregation's partitioning,
    would sort the whole group in one task.
    """
    digest = F.unhex(F.md5(F.to_json(F.array(*[F.col(c).cast("string") for c in grain]))))
    keyed = df.withColumn("__key", F.nullif(digest, F.lit(b"")))
    latest = keyed.groupBy("__key").agg(F.max(F.struct(*order)).alias("__latest"))
    latest = latest.select(F.col("__key").alias("__group"), "__latest")
    joined = keyed.join(latest, keyed["__key"].eqNullSafe(latest["__group"]), "left")
    flag = F.when(F.struct(*order) == F.col("__latest"), F.lit("Y")).otherwise(F.lit("N"))
    return joined.withColumn(name, flag).drop("__latest", "__key", "__group")


# ------------------------------------------------------ T7 book-of-business rules

RULE_CONDITIONS = ("source_book_of_business", "payer_role", "plan_type", "lives_source")


def apply_book_rules(df: DataFrame, rules: DataFrame, name: str = "book_of_business",
                     default: str = "Commercial") -> DataFrame:
    """The book of business of the first rule that holds (lowest priority number, then the lesser book).

    The rule table has a priority, a book_of_business and any of the condition
    columns, NULL meaning "any". Each rule states a set of conditions (a bit
    mask). Each of the fact's distinct condition values is looked up once for
    every set, with the columns outside the set empty: one join with the rules,
    whose best match goes back to the rows by a NULL-safe join. A NULL value
    meets only rules that do not state its column. Nothing is counted or read
    on the driver, and the number of rules is not limited.
    """
    conds = [c for c in RULE_CONDITIONS if c in rules.columns]
    values = [f"__v_{c}" for c in conds]
    least = F.min(F.struct("priority", "book_of_business")).alias("__rule")
    stated = [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(conds)]
    mask = reduce(lambda a, b: a + b, stated, F.lit(0)).alias("__mask")
    first = rules.groupBy(mask, *[F.col(c).alias(f"__r_{c}") for c in conds]).agg(least).alias("r")
    found = df.select(*[F.col(c).alias(v) for c, v in zip(conds, values)]).distinct()
    found = found.select(*values, F.explode(F.sequence(F.lit(0), F.lit((1 << len(conds)) - 1))).alias("__mask")).alias("f")
    same = F.col("f.__mask") == F.col("r.__mask")
    for i, (c, v) in enumerate(zip(conds, values)):
        in_set = F.col("f.__mask").bitwiseAND(F.lit(1 << i)) != 0
        found = found.filter(~in_set | F.col(f"f.{v}").isNotNull())
        same = same & F.when(in_set, F.col(f"f.{v}")).eqNullSafe(F.col(f"r.__r_{c}"))
    best = found.join(first, same).groupBy(*[F.col(f"f.{v}").alias(v) for v in values]).agg(F.min("r.__rule").alias("__rule"))
    chosen = best.select(*values, F.col("__rule.book_of_business").alias("__book"))
    base = df.drop(name) if name in df.columns and name not in conds else df
    same = reduce(and_, [base[c].eqNullSafe(chosen[v]) for c, v in zip(conds, values)], F.lit(True))
    out = base.join(chosen, same, "left").drop(*values)
    return out.withColumn(name, F.coalesce("__book", F.lit(default))).drop("__book")


# ------------------------------------------------------------ T8 load time

LOAD_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def with_load_time(df: DataFrame, at: str | None = None, name: str = "load_time") -> DataFrame:
    """ISO 8601 load stamp: the given text (reruns match), else the query's UTC start time."""
    if at is not None:
        return df.withColumn(name, F.lit(at))
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), LOAD_TIME_FORMAT)
    return df.withColumn(name, stamp)


# ------------------------------------------------------------ T9 feed union


def union_feeds(feeds: dict[str, DataFrame], source_col: str = "lives_source") -> DataFrame:
    """Stack feeds by column name, missing columns as NULL, each row tagged with its feed's source."""
    out = None
    for source, df in feeds.items():
        tagged = df.withColumn(source_col, F.lit(source))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no feed given")
    return out


# --------------------------------------------------------------- T10 dedup


def dedup(df: DataFrame, key: str = "row_hashkey", newest_by: Sequence[str] | None = None) -> DataFrame:
    """One row per key: any one of identical copies, or the newest by ``newest_by``.

    Of rows that tie on the order, the one with the largest hash of its content
    stays, so a rerun gives the same rows. Spark applies the limit of one row
    per key before the shuffle too, so a key repeated very often sends one row
    per task.
    """
    if not newest_by:
        return df.dropDuplicates([key])
    last = [F.col(c).desc() for c in newest_by] + [content_hash([c for c in df.columns if c != key]).desc()]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*last))
    return df.withColumn("__nth", first).filter(F.col("__nth") == 1).drop("__nth")
