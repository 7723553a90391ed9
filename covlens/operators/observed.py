"""Row rules measured while a load is written (Q1-Q8, Q10-Q15, Q17, Q18).

``quality.check_lives`` reads the whole fact for each report. Here every load
counts its own checked and failed rows as it is written (``DataFrame.observe``),
and a mark keeps the counts beside the name of the load's folder. The counts
add up, so a report over the stored fact is a sum over its marks, a row for
each rule and load, and no row of the fact is read for it.

The counts are taken in the stage that writes, after any shuffle, where Spark
counts each task once however often it was tried. They are held against the
number of rows in the written files (read from the files' footers) before the
mark is added; a load without a mark is in neither the report nor the fact. A
load's name tells it: a name that has its mark is not loaded again, so a
replayed batch of a stream is counted once.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.schemas import LIVES_SCHEMA
from .quality import row_rules, rule_counts, with_verdict
from .rollup import path_missing

_MARK = "load string, data string, rows long, rules array<struct<rule: string, checked: long, failed: long, allowed_fraction: double>>"


def _marks(spark: SparkSession, path: str) -> DataFrame:
    """One mark for each load; of two runs of a load that raced, the lesser folder's."""
    try:
        marks = spark.read.schema(_MARK).parquet(f"{path.rstrip('/')}/marks")
    except AnalysisException as error:
        if not path_missing(error):
            raise
        return spark.createDataFrame([], _MARK)
    return marks.groupBy("load").agg(F.min_by(F.struct("data", "rows", "rules"), "data").alias("m")).select("load", "m.*")


def load_observed(df: DataFrame, path: str, load: str) -> bool:
    """Write a load of lives rows under ``path`` with its rule counts; False if the load is there already.

    The rows are written in the partitions they come in. An empty load gets a
    mark with zeros.
    """
    spark = df.sparkSession
    if not _marks(spark, path).filter(F.col("load") == load).isEmpty():
        return False
    data = f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    seen = Observation()
    observed = df.select(*LIVES_SCHEMA.fieldNames()).observe(seen, F.count(F.lit(1)).alias("rows"), *rule_counts())
    observed.write.parquet(data)
    counts = seen.get
    written = spark.read.schema(LIVES_SCHEMA).parquet(data).count()
    if written != counts["rows"]:
        raise RuntimeError(f"{written} rows written where {counts['rows']} were counted")
    rules = [(name, counts[f"{name}__checked"], counts[f"{name}__failed"], allowed) for name, _, _, allowed in row_rules()]
    mark = spark.createDataFrame([(load, data, written, rules)], _MARK)
    mark.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/marks")
    return True


def start_observed_loads(spark: SparkSession, source: str, path: str, checkpoint: str, name: str = "stream",
                         available_now: bool = False, every: str = "5 minutes") -> StreamingQuery:
    """A stream that loads the files arriving in ``source``; each micro-batch is a load ``name``/number."""
    stream = spark.readStream.schema(LIVES_SCHEMA).parquet(source)

    def load(batch: DataFrame, batch_id: int) -> None:
        load_observed(batch, path, f"{name}/{batch_id}")

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def read_observed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all marked loads."""
    folders = [r["data"] for r in _marks(spark, path).select("data").collect()]  # a row for each load
    return spark.read.schema(LIVES_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], LIVES_SCHEMA)


def report_by_load(spark: SparkSession, path: str) -> DataFrame:
    """A row for each load and rule: the load a failure came with."""
    return with_verdict(_marks(spark, path).select("load", F.explode("rules").alias("r")).select("load", "r.*"))


def observed_report(spark: SparkSession, path: str) -> DataFrame:
    """``check_lives`` of all marked loads, from the counts kept when they were written."""
    kept = _marks(spark, path).select(F.explode("rules").alias("r")).select("r.*")
    summed = kept.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("checked", "failed")], F.max("allowed_fraction").alias("allowed_fraction"))
    return with_verdict(summed)
