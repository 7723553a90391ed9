"""Key uniqueness of a load against all that was loaded before, without regrouping the fact (Q9, Q16).

Bloom filters of the keys are kept beside the fact. A key sets four bits of one
64-bit word; which word and which bits follow from two hashes of its values
(NULL a value like any other). Every load adds its words to two sets of filters:

* one over all keys ever loaded, of a size fixed when the store begins
  (``expected`` keys, about two bytes each);
* one for each period of the load, sized by that load's rows of the period.

The hashes of a load's keys are looked up in the first by a join on the word's
number, which sends on repeats and a few per cent of the rest; only those are
looked up in the periods' filters. The periods that answer yes are then read,
key columns alone, and the candidates counted there, and in the load, by the key itself. So a key reported is
a key that repeats, and no repeat is missed, since a filter never denies a key
it holds. Where more keys than expected were loaded, the first filter sends on
more candidates (``fill`` tells); the result stays the same.

Words are spread by hashes and combined before the shuffle, so a key that is very
common is one word's work. What crosses to the driver is the list of the
loads' periods with the sizes of their filters.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import LIVES_KEY
from .prepare import content_hash
from .rollup import path_missing

#: Keys to a 64-bit word, and bits that a key sets in it.
KEYS_PER_WORD = 4
BITS = 4
#: Words of 64 bits in the bitmap of candidate hashes that goes to all tasks (8 MB of bits at most).
MAP_WORDS = 1 << 20

_MARK = "load string, data string, blocks long, periods array<struct<period: string, blocks: long>>"


def _word(h: Column, blocks: Column) -> Column:
    return F.pmod(h, blocks)


def _mask(h: Column) -> Column:
    """Four bits out of 64, told by a second hash of the key's hash."""
    again = F.xxhash64(h, F.lit(1))
    places = [F.shiftrightunsigned(again, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places])


def _holds(bits: str, mask: str) -> Column:
    return F.coalesce(F.col(bits).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))


def _marks(spark: SparkSession, path: str) -> list:
    """One mark for each load, as rows on the driver; of two runs of a load that raced, the lesser folder's."""
    try:
        marks = spark.read.schema(_MARK).parquet(f"{path.rstrip('/')}/marks")
    except AnalysisException as error:
        if not path_missing(error):
            raise
        return []
    return marks.groupBy("load").agg(F.min_by(F.struct("data", "blocks", "periods"), "data").alias("m")).select("load", "m.*").collect()


def _period(part: str) -> Column:
    return F.col(part).cast("string")


def add_keys(load: DataFrame, path: str, name: str, key: Sequence[str] = LIVES_KEY, part: str = "date_id",
             expected: int = 1 << 30) -> bool:
    """Add a load's keys to the filters under ``path``; False if the load ``name`` was added before.

    ``expected`` counts for the first load alone. ``key`` and ``part`` must be
    the same for all loads of a store.
    """
    spark = load.sparkSession
    held = _marks(spark, path)
    if any(m["load"] == name for m in held):
        return False
    blocks = held[0]["blocks"] if held else max(1, -(-expected // KEYS_PER_WORD))
    keys = load.select(_period(part).alias("period"), content_hash(key).alias("h"))
    sizes = keys.groupBy("period").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each period
    periods = [(r["period"], max(1, -(-r["n"] // KEYS_PER_WORD))) for r in sizes]
    data = f"{path.rstrip('/')}/filters/{uuid.uuid4().hex}"
    words = keys.select(_word(F.col("h"), F.lit(blocks)).alias("word"), _mask(F.col("h")).alias("mask"))
    words.groupBy("word").agg(F.bit_or("mask").alias("bits")).write.parquet(f"{data}/all")
    size = spark.createDataFrame(periods, "p string, blocks long")
    sized = keys.join(size, keys["period"].eqNullSafe(size["p"]))
    words = sized.select("period", _word(F.col("h"), F.col("blocks")).alias("word"), _mask(F.col("h")).alias("mask"))
    words.groupBy("period", "word").agg(F.bit_or("mask").alias("bits")).write.parquet(f"{data}/periods")
    mark = spark.createDataFrame([(name, data, blocks, periods)], _MARK)
    mark.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/marks")
    return True


def _filters(spark: SparkSession, held: list, kind: str) -> DataFrame:
    columns = {"all": "word long, bits long", "periods": "period string, word long, bits long"}[kind]
    tagged = [spark.read.schema(columns).parquet(f"{m['data']}/{kind}").withColumn("load", F.lit(m["load"])) for m in held]
    return reduce(DataFrame.unionByName, tagged)


def fill(spark: SparkSession, path: str) -> float:
    """Share of bits set in the filter over all keys; from about a half on, begin a store for more keys."""
    held = _marks(spark, path)
    if not held:
        return 0.0
    words = _filters(spark, held, "all").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return (words.agg(F.sum(F.bit_count("bits")).alias("n")).first()["n"] or 0) / (64 * held[0]["blocks"])


def maybe_known(spark: SparkSession, path: str, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``keys`` (distinct) that some period's filter holds, one for each such period, with ``period``."""
    return _held_hashes(spark, path, keys.withColumn("__h", content_hash(key))).drop("__h")


def _held_hashes(spark: SparkSession, path: str, hashed: DataFrame) -> DataFrame:
    """The rows (distinct, with a key's hash ``__h``) that some period's filter holds, as ``maybe_known`` gives them."""
    held = _marks(spark, path)
    entries = [F.struct(F.lit(m["load"]).alias("load"), F.lit(p["period"]).cast("string").alias("period"), F.lit(p["blocks"]).alias("blocks"))
               for m in held for p in m["periods"]]
    if not entries:
        return hashed.withColumn("period", F.lit(None).cast("string")).filter(F.lit(False))
    looked = hashed.withColumns({"__word": _word(F.col("__h"), F.lit(held[0]["blocks"])), "__mask": _mask(F.col("__h"))})
    bits = _filters(spark, held, "all").groupBy("word").agg(F.bit_or("bits").alias("__bits"))
    passed = looked.join(bits, F.col("__word") == F.col("word")).filter(_holds("__bits", "__mask"))
    asked = passed.select(*hashed.columns, "__mask", F.explode(F.array(*entries)).alias("__e"))
    asked = asked.withColumn("__word", _word(F.col("__h"), F.col("__e.blocks"))).alias("a")
    of = _filters(spark, held, "periods").alias("f")
    same = (F.col("a.__word") == F.col("f.word")) & (F.col("a.__e.load") == F.col("f.load")) \
        & F.col("a.__e.period").eqNullSafe(F.col("f.period"))
    hits = asked.join(of, same).filter(_holds("f.bits", "a.__mask"))
    return hits.select(*[F.col(f"a.{c}") for c in hashed.columns], F.col("a.__e.period").alias("period")).distinct()


def _likely(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows whose ``__h`` is among ``hashes``, and a few more, without a shuffle of rows: by a broadcast bitmap of ``MAP_WORDS`` words."""
    word, bit = F.pmod("__h", F.lit(MAP_WORDS)), F.pmod(F.floor(F.col("__h") / MAP_WORDS), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = hashes.groupBy(word.alias("__word")).agg(F.bit_or(one).alias("__bits"))
    marked = rows.withColumns({"__word": word, "__mask": one})
    return marked.join(F.broadcast(words), "__word").filter(_holds("__bits", "__mask")).drop("__word", "__mask", "__bits")


def repeats_of_load(spark: SparkSession, path: str, history: DataFrame, load: DataFrame,
                    key: Sequence[str] = LIVES_KEY, part: str = "date_id", scratch: str | None = None) -> DataFrame:
    """Keys of a load that repeat within it or were loaded before: key, rows in_load, rows in_history.

    ``history`` is the fact that the store's loads make up, the new load not
    included; only its periods that may hold a key of the load are read. The
    load is counted and looked up by its keys' hashes; only rows whose hash
    repeats or is held are grouped by the key itself. ``scratch`` is a fresh
    folder for these hashes; without it they are worked out three times.
    """
    load, history = (df.select(*{**dict.fromkeys(key), part: None}, content_hash(key).alias("__h")) for df in (load, history))
    counted = load.groupBy("__h").agg(F.count(F.lit(1)).alias("n"))
    held = _held_hashes(spark, path, counted.select("__h")).withColumn("known", F.lit(True))
    repeated = counted.filter("n > 1").select("__h", F.lit(None).cast("string").alias("period"), F.lit(False).alias("known"))
    told = held.unionByName(repeated)
    if scratch is not None:
        told.write.parquet(scratch)
        told = spark.read.schema(told.schema).parquet(scratch)
    periods = [r["period"] for r in told.filter("known").select("period").distinct().collect()]  # a row for each period
    named = [p for p in periods if p is not None]
    wanted = _period(part).isin(named) if named else F.lit(False)
    if None in periods:
        wanted = wanted | F.col(part).isNull()

    def counts(rows: DataFrame, hashes: DataFrame, name: str) -> DataFrame:
        some = _likely(rows, hashes) if scratch is not None else rows
        # Not a semi join: the optimizer would move that below the bitmap's join, and all rows would be shuffled.
        return some.join(hashes.select("__h").distinct(), "__h").groupBy(*key).agg(F.count(F.lit(1)).alias(name))

    new = counts(load, told, "in_load").alias("l")
    old = counts(history.filter(wanted), told.filter("known"), "n").alias("o")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in key])
    out = new.join(old, same, "left").select(*[F.col(f"l.{c}") for c in key], "l.in_load", F.coalesce("o.n", F.lit(0)).alias("in_history"))
    return out.filter((F.col("in_load") > 1) | (F.col("in_history") > 0))
