"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


#: Rows that a Python worker gets at once: whole texts and sets are long rows.
BATCH_ROWS = 1_000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends its Python workers at most BATCH_ROWS rows at once (never set back, so queries
    side by side do not change it under each other)."""
    if not 0 < int(spark.conf.get(_ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ARROW_ROWS, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The frame written once to the shared folder and read back: lineage ends there.

    Files of lost executors stay readable, and every later use reads the same
    rows. The folder is the shared folder's ``covlens/llm``; who names the shared
    folder empties it when no result is read from it any more.
    """
    small_batches(df.sparkSession)
    path = fresh_path(df.sparkSession, f"llm/{kind}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system: Spark keeps workers for later tasks, and an
    executor's limit counts what idle ones hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def lean(run):
    """``run`` over a task's batches, whose worker then gives back the memory that it no longer uses."""

    def each(batches):
        yield from run(batches)
        give_back()

    return each


def sliced(run, rows: int = BATCH_ROWS):
    """``run`` over batches of at most ``rows`` rows, whatever the session sends (64 MB at most by Spark's default); ``lean``."""

    def each(batches):
        return run(batch.slice(first, rows) for batch in batches for first in range(0, max(1, batch.num_rows), rows))

    return lean(each)


def with_row_id(docs: DataFrame, kind: str, name: str = "_rid") -> DataFrame:
    """The documents, stored, with a row number of their own: doc_id may be null or repeated."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), kind)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 5; remainder 0 is held out. A null doc_id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0))
