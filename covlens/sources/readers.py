"""Readers for the coverage tables.

A source is a storage path (anything with a slash, read as Parquet) or a
catalog table name. Every call re-lists the files, so a reader called after a
load sees the new data; nothing is cached here (the refresh keys of the model
become "re-read per call").
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import CONFIG_SCHEMA, HIERARCHY_KEY, LIVES_NUMBER_COLUMNS, LIVES_SCHEMA, check_schema


def _table_name(name: str) -> str:
    # Catalog names holding hyphens or other punctuation need backticks per part.
    parts = [p.strip('`"') for p in name.split(".")]
    return ".".join(f"`{p}`" for p in parts)


def _is_path(source: str) -> bool:
    return "/" in source or source.startswith("file:")


def read_source(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A DataFrame over a path (Parquet), a catalog table, or a DataFrame given as is."""
    if isinstance(source, DataFrame):
        return source
    if _is_path(source):
        return spark.read.parquet(source)
    return spark.table(_table_name(source))


def _integral(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return True
    return isinstance(dtype, T.DecimalType) and dtype.scale == 0 and dtype.precision <= 18


#: Declared texts whose folder names lose nothing when Spark has read them as whole numbers.
_PLAIN_NUMBERS = ("date_year", "date_id")


def _folder_texts(spark: SparkSession, source: str | DataFrame, df: DataFrame) -> DataFrame:
    """Folder columns as the texts that the folder names spell.

    Spark infers the type of a partition column from its folder names: a year
    reads as a number, ``zip=01234`` as 1234, a load day as a date. A path is
    read again with those columns declared as text, so every character of the
    name is kept; no job runs, only the listing that Spark has anyway. Only
    columns that stand in the path of the files are declared so; a number
    stored in the files stays refused. A DataFrame given as is has lost the
    names: its year and month folders are given back as text, others are refused.
    """
    texts = [f.name for f in LIVES_SCHEMA.fields if f.dataType == T.StringType()]
    guessed = [f.name for f in df.schema.fields if f.name in texts and f.dataType != T.StringType()]
    if not guessed:
        return df
    try:
        first = df.inputFiles()[:1]
    except AnalysisException:  # not read from files
        first = []
    folders = [c for c in guessed if first and f"/{c}=" in first[0]]
    if not folders:
        return df
    if isinstance(source, DataFrame) or not _is_path(source):
        whole = [c for c in folders if c in _PLAIN_NUMBERS and _integral(df.schema[c].dataType)]
        return df.withColumns({c: F.col(c).cast("string") for c in whole}) if whole else df
    kinds = [T.StructField(f.name, T.StringType() if f.name in folders else f.dataType) for f in df.schema.fields]
    return spark.read.schema(T.StructType(kinds)).parquet(source)


def read_lives(spark: SparkSession, source: str | DataFrame, where: Column | None = None) -> DataFrame:
    """The lives fact (S1): every column, checked against the declared schema.

    Lives stored as any whole-number type are widened to LongType (D3); text
    or fractional lives are refused, since Spark would sum them as doubles.
    ``where`` is the filter group of the base scan (F1): one boolean Column
    that Catalyst pushes into the Parquet scan as a whole; ``None`` means no
    filter.
    """
    df = read_source(spark, source)
    df = _folder_texts(spark, source, df)
    types = {f.name: f.dataType for f in df.schema.fields}
    widen = [c for c in LIVES_NUMBER_COLUMNS
             if c in types and types[c] != T.LongType() and _integral(types[c])]
    if widen:
        df = df.withColumns({c: F.col(c).cast(T.LongType()) for c in widen})
    check_schema(df, LIVES_SCHEMA, "lives fact")
    return df if where is None else df.filter(where)


def read_benefit_config(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """The benefit-type configuration table."""
    df = read_source(spark, source)
    check_schema(df, CONFIG_SCHEMA, "benefit-type configuration")
    return df


def read_hierarchy(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """The organisation hierarchy (S4); only its key column is declared."""
    df = read_source(spark, source)
    if HIERARCHY_KEY not in df.columns:
        raise ValueError(f"organisation hierarchy: missing column {HIERARCHY_KEY}")
    return df
