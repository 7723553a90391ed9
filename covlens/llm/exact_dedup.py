"""Exact dedup through a minimal perfect hash over historical distinct digests.

History is indexed once: its distinct digests are dealt into buckets by their
leading bits, and every bucket gets a minimal perfect hash whose slots hold
the full digest and a locator of the winning row. New rows, summed per digest
first (so a text that makes up a third of all rows is one probe), look their
slot up and compare the full 32 bytes: equal ones are repeats of history, the
others are grouped among themselves.

Defined results: null text counts as empty; of equal rows the one with the
smallest doc_id stays (null ids last), among equal ids the first by row
number; an empty table gives an empty result; only doc_id and text are read,
so other columns never clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, stored, with_row_id

#: Distinct digests of one bucket, on average; a bucket is one task's unit of work.
BUCKET_DIGESTS = 16_384
#: Cells per key at each level of the perfect hash.
GAMMA = 2.0
MAX_LEVELS = 48

_GROUP_SCHEMA = "digest binary, has_id boolean, win_id long, win_rid long, group_size long, in_history boolean"
_INDEX_SCHEMA = "bucket int, sizes array<int>, bits binary, digests binary, has_id binary, ids binary, rids binary, counts binary"


def normalised(text: Column) -> Column:
    """The text with every run of white space made one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The cell of each key (8 bytes of its digest) at a level."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x % np.uint64(size)).astype(np.int64)


def _keys(digests: np.ndarray) -> np.ndarray:
    """The last 8 bytes of each digest; the leading ones chose the bucket."""
    return np.ascontiguousarray(digests[:, 24:32]).view("<u8").ravel()


def build_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, the bits of all levels, and the slot of each distinct digest (n x 32 bytes).

    A key takes the first level at which no other remaining key has its cell;
    its slot is the number of set bits before it, so n keys fill slots 0 to
    n - 1. Keys equal in the hashed bytes never part; they are left without a
    level and get the last slots, which a lookup scans.
    """
    keys, left = _keys(digests), np.arange(len(digests))
    sizes, levels, where = [], [], np.full(len(digests), -1, np.int64)
    base = 0
    while len(left) and len(sizes) < MAX_LEVELS:
        size = max(8, int(GAMMA * len(left)))
        cell = _cells(keys[left], len(sizes), size)
        alone = np.bincount(cell, minlength=size) == 1
        placed = alone[cell]
        where[left[placed]] = base + cell[placed]
        sizes.append(size)
        levels.append(alone)
        left, base = left[~placed], base + size
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    rank = np.cumsum(bits) - bits
    slot = np.where(where >= 0, rank[np.maximum(where, 0)] if len(bits) else 0, -1)
    slot[left] = int(bits.sum()) + np.arange(len(left))
    return sizes, bits, slot


def find(digests: np.ndarray, sizes: list[int], bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The slot that holds each digest, or -1; every hit is checked on all 32 bytes."""
    out = np.full(len(digests), -1, np.int64)
    if not len(slots) or not len(digests):
        return out
    keys, left, base = _keys(digests), np.arange(len(digests)), 0
    rank = np.cumsum(bits) - bits
    for level, size in enumerate(sizes):
        cell = base + _cells(keys[left], level, size)
        hit = bits[cell]
        out[left[hit]] = rank[cell[hit]]
        left, base = left[~hit], base + size
    sure = np.flatnonzero(out >= 0)
    out[sure[(slots[out[sure]] != digests[sure]).any(axis=1)]] = -1
    tail = {bytes(d): i for i, d in enumerate(slots[int(bits.sum()):], int(bits.sum()))}
    for i in np.flatnonzero(out < 0) if tail else ():
        out[i] = tail.get(bytes(digests[i]), -1)
    return out


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(v) for v in values), np.uint8).reshape(-1, 32)


def _build_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(rows["digest"])
    sizes, bits, slot = build_hash(digests)
    order = np.argsort(slot)
    put = lambda name, kind: rows[name].to_numpy()[order].astype(kind).tobytes()
    return pd.DataFrame([{
        "bucket": int(rows["bucket"].iloc[0]), "sizes": sizes, "bits": np.packbits(bits).tobytes(),
        "digests": digests[order].tobytes(), "has_id": put("has_id", "u1"), "ids": put("win_id", "<i8"),
        "rids": put("win_rid", "<i8"), "counts": put("group_size", "<i8"),
    }])


def _probe_bucket(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The groups of one bucket: every slot, with the new rows found in it added, and every nonmember."""
    parts = []
    slot = np.full(len(new), -1, np.int64)
    probe = _matrix(new["digest"]) if len(new) else np.zeros((0, 32), np.uint8)
    if len(index):
        ix = index.iloc[0]
        sizes = [int(s) for s in ix["sizes"]]
        bits = np.unpackbits(np.frombuffer(ix["bits"], np.uint8), count=sum(sizes)).astype(bool)
        slots = np.frombuffer(ix["digests"], np.uint8).reshape(-1, 32)
        slot = find(probe, sizes, bits, slots)
        held = pd.DataFrame({
            "digest": [bytes(d) for d in slots], "has_id": np.frombuffer(ix["has_id"], "u1").astype(bool),
            "win_id": np.frombuffer(ix["ids"], "<i8"), "win_rid": np.frombuffer(ix["rids"], "<i8").copy(),
            "group_size": np.frombuffer(ix["counts"], "<i8").copy(),
        })
        held["win_id"] = held["win_id"].copy()
        member = np.flatnonzero(slot >= 0)
        at = slot[member]
        fresh = new.iloc[member]
        sizes_now = held["group_size"].to_numpy().copy()
        sizes_now[at] += fresh["group_size"].to_numpy()
        held["group_size"] = sizes_now
        old = list(zip(~held["has_id"].to_numpy()[at], held["win_id"].to_numpy()[at], held["win_rid"].to_numpy()[at], strict=True))
        now = list(zip(~fresh["has_id"].to_numpy().astype(bool), fresh["win_id"].to_numpy(), fresh["win_rid"].to_numpy(), strict=True))
        better = np.array([n < o for n, o in zip(now, old, strict=True)], bool)
        for name in ("has_id", "win_id", "win_rid"):
            values = held[name].to_numpy().copy()
            values[at[better]] = fresh[name].to_numpy()[better]
            held[name] = values
        held["in_history"] = True
        parts.append(held)
    rest = new[slot < 0][["digest", "has_id", "win_id", "win_rid", "group_size"]].copy()
    rest["in_history"] = False
    parts.append(rest)
    return pd.concat(parts, ignore_index=True)


def _summed(rows: DataFrame) -> DataFrame:
    """One row per digest: its first row by (id is null, id, row number), and its count."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "_rid"))
    return rows.groupBy("digest").agg(first.alias("w"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", (~F.col("w.none")).alias("has_id"), F.col("w.id").alias("win_id"), F.col("w._rid").alias("win_rid"), "group_size"
    )


def _bucketed(sums: DataFrame, buckets: int) -> DataFrame:
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return sums.withColumn("bucket", (lead % buckets).cast("int"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The perfect-hash index over history's digests (digest, doc_id, _rid), one row per bucket."""
    return _bucketed(_summed(history), buckets).groupBy("bucket").applyInPandas(_build_bucket, _INDEX_SCHEMA)


def probe_index(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """All groups of history and new rows together, one row per digest."""
    probes = _bucketed(_summed(new), buckets)
    return probes.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_probe_bucket, _GROUP_SCHEMA)


def digest_groups(rows: DataFrame) -> DataFrame:
    """Groups of a table of (digest, doc_id, _rid): half of the rows, by row number, serve as history."""
    half = F.xxhash64("_rid") % 2 == 0
    distinct = rows.agg(F.approx_count_distinct("digest")).first()[0]
    buckets = max(1, -(-distinct // BUCKET_DIGESTS))
    index = stored(build_index(rows.filter(half), buckets), "perfect-hash")
    return probe_index(rows.filter(~half), index, buckets)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, _rid, digest, keep_id, group_size, kept, in_history."""
    rows = with_row_id(docs.select("doc_id", digest_of(F.col("text")).alias("digest")), "digests")
    return _verdicts(rows)


def _verdicts(rows: DataFrame) -> DataFrame:
    groups = digest_groups(rows)
    joined = rows.join(groups, "digest")
    return joined.select(
        "doc_id", "_rid", "digest", F.when(F.col("has_id"), F.col("win_id")).alias("keep_id"), "group_size",
        (F.col("_rid") == F.col("win_rid")).alias("kept"), "in_history",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the repeats, with the columns of docs.

    Rows are told apart by doc_id and digest, so the documents are read twice
    and not copied; of rows equal in both, any one stays.
    """
    name = "_digest"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    rows = with_row_id(docs.select("doc_id", digest_of(F.col("text")).alias("digest")), "digests")
    same_id = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = stored(_verdicts(rows).filter(~F.col("kept")).select("doc_id", "digest", same_id.alias("again")).distinct(), "repeats")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_gone"), "again")
    # The repeats grow with the documents, so the join is a shuffled one at every size.
    marked = docs.withColumn(name, digest_of(F.col("text"))).hint("merge")
    same = marked["doc_id"].eqNullSafe(gone["_id"]) & (marked[name] == gone["_gone"])
    out = marked.join(gone.filter(~F.col("again")), same, "left_anti")
    again = gone.filter("again")
    if not again.isEmpty():
        out = out.join(again, same, "left_anti").union(out.join(again, same, "left_semi").dropDuplicates(["doc_id", name]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
