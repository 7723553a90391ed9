"""Histogram sort: documents into shards of near equal bytes, in key order, with one exchange.

The sort key is (hash of the text, hash of doc_id), so equal texts stand
together. Splitters are found by counting: each round sums the exact bytes in
the cells between candidate boundaries over all partitions, and only the
cells that hold a wanted splitter are divided further, until every splitter is
within the tolerance of its target or its cell cannot be divided. Only the
counts of at most (shards - 1) x 64 cells reach the driver in a round. A group
of equal texts is cut only where keeping it whole would break the tolerance.

Defined results: null text has no bytes (size 16), null doc_id is a value like
any other, equal rows may get any order among themselves; an empty table gives
an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes that a document counts beside its text.
OVERHEAD = 16
#: A splitter may miss its target by this part of one shard's bytes.
TOLERANCE = 0.002
FIRST_BITS = 12
STEP_BITS = 6
#: Rows of one sub-range of a shard, in which slots are numbered by one task.
SLOT_ROWS = 20_000

_LOW = -(1 << 63)


def sort_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), "doc_id").alias("h2"),
    )


def _prefix(key: str, bits: int) -> Column:
    return F.shiftright(F.col(key), 64 - bits)


class _Cell:
    """An interval of one key with its bytes; below: the bytes of all keys before it."""

    def __init__(self, prefix: int, low: int, high: int, nbytes: int, below: int) -> None:
        self.prefix, self.low, self.high, self.nbytes, self.below = prefix, low, high, nbytes, below


def _counted(keys: DataFrame, key: str, bits: int, parent: Column | None, where: Column | None) -> list:
    """(parent, prefix, bytes, smallest and largest key) of the cells in order; exact sums over all rows."""
    rows = keys if where is None else keys.filter(where)
    out = rows.groupBy((F.lit(0) if parent is None else parent).alias("parent"), _prefix(key, bits).alias("cell")).agg(
        F.sum("size").alias("nbytes"), F.min(key).alias("low"), F.max(key).alias("high")
    )
    return sorted(out.collect(), key=lambda r: (r["parent"], r["cell"]))


def _locate(cells: list[_Cell], target: int, tolerance: float) -> tuple[_Cell | None, _Cell | None]:
    """(cell to start a shard at, None) if a boundary is near enough, else (None, cell to divide)."""
    for i, c in enumerate(cells):
        if c.below + c.nbytes > target:
            before, after = target - c.below, c.below + c.nbytes - target
            if min(before, after) <= tolerance:
                return (c if before <= after else cells[i + 1] if i + 1 < len(cells) else None), None
            return None, c
    return None, None


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The first key (h1, h2) of shards 1 to shards - 1, in order; fewer if rows run out."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    near = tolerance * total / shards
    targets = {s: total * s // shards for s in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    open_: dict[int, _Cell] = {}
    groups: dict[int, _Cell] = {}

    def settle(s: int, cells: list[_Cell], end: _Cell | None, value, bits: int) -> None:
        """Fix splitter s, or leave it open in the cell that holds it."""
        start, inside = _locate(cells, targets[s], near)
        if start is not None:
            found[s] = value(start)
        elif inside is None:  # the boundary is the end of the divided cell
            found[s] = value(end) if end is not None else (1 << 63, 0)
        elif inside.low == inside.high or bits >= 64:
            groups[s] = inside
        else:
            open_[s] = inside

    bits, cells, below = FIRST_BITS, [], 0
    for r in _counted(keys, "h1", bits, None, None):
        cells.append(_Cell(r["cell"], r["low"], r["high"], r["nbytes"], below))
        below += r["nbytes"]
    for s in targets:
        settle(s, cells, None, lambda c: (c.low, _LOW), bits)
    while open_:
        now, open_ = open_, {}
        parents = sorted({c.prefix for c in now.values()})
        rows = _counted(keys, "h1", min(64, bits + STEP_BITS), _prefix("h1", bits), _prefix("h1", bits).isin(parents))
        bits = min(64, bits + STEP_BITS)
        for s, parent in now.items():
            cells, below = [], parent.below
            for r in rows:
                if r["parent"] == parent.prefix:
                    cells.append(_Cell(r["cell"], r["low"], r["high"], r["nbytes"], below))
                    below += r["nbytes"]
            settle(s, cells, _After(parent.high), lambda c: (c.low, _LOW), bits)

    # Splitters inside one group of equal texts: divide it by the hash of doc_id.
    bits, h1 = 0, {}
    pending, groups = groups, {}
    for s, c in pending.items():
        h1[s], open_[s] = c.low, _Cell(0, _LOW, -_LOW - 1, c.nbytes, c.below)
    while open_:
        now, open_ = open_, {}
        pick = F.lit(False)
        for s, c in now.items():
            inside = F.col("h1") == h1[s]
            pick = pick | (inside & (_prefix("h2", bits) == c.prefix) if bits else inside)
        step = min(64, bits + (FIRST_BITS if not bits else STEP_BITS))
        both = F.struct(F.col("h1"), (_prefix("h2", bits) if bits else F.lit(0)).cast("long").alias("p"))
        rows = _counted(keys, "h2", step, both, pick)
        bits = step
        for s, parent in now.items():
            cells, below = [], parent.below
            for r in rows:
                if tuple(r["parent"]) == (h1[s], parent.prefix):
                    cells.append(_Cell(r["cell"], r["low"], r["high"], r["nbytes"], below))
                    below += r["nbytes"]
            settle(s, cells, _After(parent.high), lambda c, g=h1[s]: (g, c.low), bits)
        for s, c in groups.items():  # rows that cannot be told apart: the nearer side
            low = targets[s] - c.below <= c.below + c.nbytes - targets[s]
            found[s] = (h1[s], c.low if low else c.high + 1)
        groups = {}
    return [found[s] for s in sorted(found)]


class _After:
    """The first key after a cell."""

    def __init__(self, high: int) -> None:
        self.low = high + 1


def shard_of(splitters: list[tuple[int, int]]) -> Column:
    """The shard of a key: how many splitters are at or before it."""
    out = F.lit(0)
    for a, b in splitters:
        if a < 1 << 63:
            reached = F.col("h1") > a
            if b == _LOW:
                reached = F.col("h1") >= a
            elif b < 1 << 63:
                reached = reached | ((F.col("h1") == a) & (F.col("h2") >= b))
            out = out + F.when(reached, 1).otherwise(0)
    return out.cast("int")


def shard(docs: DataFrame, shards: int = 40, tolerance: float = TOLERANCE) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard and its slot there, gapless from 0."""
    keys = stored(sort_keys(docs), "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)
    rows = keys.count()
    parts = max(1, -(-rows // (shards * SLOT_ROWS)))
    dealt = keys.withColumn("shard", shard_of(splitters)).withColumn("part", F.pmod(F.col("h2"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("h1", "h2", "doc_id")
    placed = dealt.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))
