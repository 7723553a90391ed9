"""Repeated long passages by compaction of a de Bruijn graph of token k-mers.

A window of WINDOW words is repeated if its word sequence starts anywhere
else. The graph is sparse: of every SPAN + 1 consecutive k-mers the one with
the smallest hash is a node (its choice depends on these words alone, so equal
windows choose alike), and the words from one node to the next are an edge.
Every window holds a node, so a window can be repeated only if a node in it is.

Nodes met once are dropped. A node does not branch on a side if all its
occurrences have the same edge there; a run of nodes that do not branch is
compacted into one path, which all occurrences of its first node share, so a
window that lies in the path around its own smallest node is repeated and need
not be looked at again. The other windows whose smallest node is repeated are
verified by 128-bit hashes of their whole word sequence at their source
coordinates (document, word).

Words move once: texts are joined with the marks of their repeated nodes, and
only those with windows to be verified are written for the last step.

Defined results: null or empty text has no words and keeps the hash of the
empty string; documents shorter than a window lose nothing; a null or repeated
doc_id is a row of its own; an empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored
from .near_dedup import chunks
from .words import _powers, mix, runs, word_hashes

WINDOW = 35
K = 8
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_RADIX = 0xD1342543DE82EF95
_INVERSE = pow(_RADIX, -1, 1 << 64)
_RADIX2 = 0xAF251AF3B0F025B5
_INVERSE2 = pow(_RADIX2, -1, 1 << 64)
_START, _END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


class Sequence:
    """Hashes of any run of words of an array of word hashes."""

    def __init__(self, hashes: np.ndarray, radix: int = _RADIX, inverse: int = _INVERSE) -> None:
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(hashes * _powers(radix, len(hashes)), out=self.total[1:])
            self.back = _powers(inverse, len(hashes) + 1)

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[first]) * self.back[first] + (end - first).astype(np.uint64))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` consecutive values."""
    out, covered = x, 1
    while 2 * covered <= width:
        out = pick(out[:-covered], out[covered:])
        covered *= 2
    rest = width - covered
    return pick(out[:-rest], out[rest:]) if rest else out


def nodes(hashes: np.ndarray, counts: np.ndarray, sequence: Sequence, window: int, k: int):
    """(kmer, least, is_node): the hash of the k-mer at each word, the smallest in each window, and the nodes.

    ``least`` has one entry per word at which a window could start; where the
    text ends before the window does it is 0. A k-mer is a node if it is the
    smallest of a window that lies in its text.
    """
    n = len(hashes)
    span = window - k + 1
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(n, bool)
    at = np.arange(n - k + 1)
    kmer = sequence.of(at, at + k) | np.uint64(1)
    least = _sliding(kmer, span, np.minimum)
    ends = np.repeat(np.cumsum(counts), counts)[:len(least)]
    least[np.arange(len(least)) + window > ends] = 0
    around = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    is_node = np.zeros(n, bool)
    is_node[:len(kmer)] = _sliding(around, span, np.maximum)[:len(kmer)] == kmer
    return kmer, least, is_node


def _key(text: Column) -> list[Column]:
    """What names a row: its doc_id (0 if null) and a hash of its text and of whether it has one."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("th")]


def occurrences(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(id, th, pos, node, edge_in, edge_out): the nodes of every text and the edges around them."""

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch):
                hashes, counts, _, _ = word_hashes(texts)
                sequence = Sequence(hashes)
                kmer, _, is_node = nodes(hashes, counts, sequence, window, k)
                at = np.flatnonzero(is_node)
                doc = np.searchsorted(np.cumsum(counts), at, side="right")
                first, end = runs(counts)[doc], np.cumsum(counts)[doc]
                same = doc[1:] == doc[:-1] if len(at) else np.zeros(0, bool)
                before, after = first.copy(), end.copy()
                before[1:][same] = at[:-1][same]
                after[:-1][same] = at[1:][same] + k
                into, out = sequence.of(before, at + k), sequence.of(at, after)
                opens, closes = np.ones(len(at), bool), np.ones(len(at), bool)
                opens[1:], closes[:-1] = ~same, ~same
                into[opens] ^= _START
                out[closes] ^= _END
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(take), part.column("th").take(take), pa.array((at - first).astype(np.int32)),
                        pa.array(kmer[at].view(np.int64)), pa.array(into.view(np.int64)), pa.array(out.view(np.int64)),
                    ],
                    ["id", "th", "pos", "node", "edge_in", "edge_out"],
                )

    text = F.col("text").cast("string")
    return docs.select(*_key(text), text.alias("text")).mapInArrow(
        run, "id long, th long, pos int, node long, edge_in long, edge_out long"
    )


def repeated_nodes(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(id, th, marks): per text its repeated nodes, each with whether all its occurrences share the edge in and the edge out."""
    found = occurrences(docs, window, k)
    counts = found.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(counts.filter("n > 1").select("node"), "repeated-nodes")
    met = stored(found.join(repeated, "node"), "repeated-occurrences")
    sides = met.groupBy("node").agg(
        (F.min("edge_in") == F.max("edge_in")).alias("same_in"), (F.min("edge_out") == F.max("edge_out")).alias("same_out")
    )
    marked = met.select("id", "th", "pos", "node").join(stored(sides, "node-sides"), "node")
    code = F.col("pos").cast("long") * 4 + F.col("same_in").cast("long") * 2 + F.col("same_out").cast("long")
    return stored(marked.groupBy("id", "th").agg(F.collect_list(code).alias("marks")), "marks")


def _covered(windows: np.ndarray, size: int, window: int) -> np.ndarray:
    """The words that windows with these first words cover."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, windows, 1)
    np.add.at(change, windows + window, -1)
    return np.cumsum(change[:-1]) > 0


def shared_windows(at: np.ndarray, marks: dict[int, int], size: int, kmer: np.ndarray, least: np.ndarray, window: int, k: int) -> np.ndarray:
    """Which windows lie in the run of words that all occurrences of their own smallest node share around it.

    at: places of all nodes of a text; marks: place of a repeated node ->
    2 * same_in + same_out. A window is judged by its own node alone, so equal
    windows are judged alike wherever they stand.
    """
    right, end = {}, size
    for i in range(len(at) - 1, -1, -1):
        p = int(at[i])
        if not marks.get(p, 0) & 1:
            end = p + k
        right[p] = end
    done = np.zeros(len(least), bool)
    left = 0
    for p in at.tolist():
        mark = marks.get(p)
        if mark is None or not mark & 2:
            left = p
        if mark is not None:
            first, last = max(left, p - (window - k)), min(right[p] - window, p)
            if first <= last:
                done[first:last + 1] |= least[first:last + 1] == kmer[p]
    return done


def _digest(words) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_STATE = (
    "doc_id long, id long, th long, n_words long, n_removed long, kept_sha256 string, text string, "
    "inside binary, starts array<int>, h1 array<long>, h2 array<long>"
)


def _resolve(window: int, k: int):
    """Per text: the words inside shared paths, and the windows that are still to be verified."""

    def run(batches):
        for batch in batches:
            rows = []
            ids, keys, ths, marks = (batch.column(c).to_pylist() for c in ("doc_id", "id", "th", "marks"))
            for i, (doc_id, key, th, mark) in enumerate(zip(ids, keys, ths, marks, strict=True)):
                text = batch.column("text")[i].as_py() or ""
                words = text.encode().split()
                n = len(words)
                if not mark:
                    rows.append((doc_id, key, th, n, 0, _digest(words), None, None, None, None, None))
                    continue
                hashes, counts, _, _ = word_hashes(pa.array([text]))
                sequence = Sequence(hashes)
                kmer, least, is_node = nodes(hashes, counts, sequence, window, k)
                places = {m >> 2: m & 3 for m in mark}
                done = shared_windows(np.flatnonzero(is_node), places, n, kmer, least, window, k)
                inside = _covered(np.flatnonzero(done), n, window)
                open_ = np.flatnonzero(np.isin(least, kmer[list(places)]) & (least > 0) & ~done)
                if not len(open_):
                    rows.append((doc_id, key, th, n, int(inside.sum()), _digest(compress(words, ~inside)), None, None, None, None, None))
                    continue
                h1 = sequence.of(open_, open_ + window).view(np.int64)
                h2 = Sequence(hashes, _RADIX2, _INVERSE2).of(open_, open_ + window).view(np.int64)
                rows.append((doc_id, key, th, n, None, None, text, np.packbits(inside).tobytes(), open_.astype(np.int32), h1, h2))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = [f.split()[0] for f in _STATE.split(", ")]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _finish(window: int):
    """The texts with verified windows: what stays of them."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                words = row["text"].encode().split()
                gone = np.unpackbits(np.frombuffer(row["inside"], np.uint8), count=len(words)).astype(bool)
                gone |= _covered(np.array(row["repeats"] or [], np.int64), len(words), window)
                rows.append((row["doc_id"], len(words), int(gone.sum()), _digest(compress(words, ~gone))))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the words that no repeated window covers."""
    text = F.col("text").cast("string")
    marks = repeated_nodes(docs, window, k)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(text), text.alias("text")).join(marks, ["id", "th"], "left")
    state = stored(rows.select("doc_id", "id", "th", "text", "marks").mapInArrow(sliced(_resolve(window, k)), _STATE), "passages")
    zipped = F.explode(F.arrays_zip("starts", "h1", "h2"))
    open_ = state.filter("text is not null").select("id", "th", zipped.alias("w")).select("id", "th", "w.starts", "w.h1", "w.h2")
    twice = stored(open_.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"), "repeated-windows")
    hits = open_.join(twice, ["h1", "h2"]).groupBy("id", "th").agg(F.collect_set("starts").alias("repeats"))
    rest = state.filter("text is not null").select("doc_id", "id", "th", "text", "inside").join(stored(hits, "window-hits"), ["id", "th"], "left")
    finished = rest.select("doc_id", "text", "inside", "repeats").mapInArrow(
        _finish(window), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
    return state.filter("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256").union(finished)
