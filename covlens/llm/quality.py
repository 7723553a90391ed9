"""Quality scores by a generalised additive model with pairwise interactions.

Each text gives a few shape features, each cut into at most BINS bins. Cyclic
boosting visits the features in turn, fits a shallow tree on the bins'
gradients and adds it, damped, to the feature's lookup table; then the pairs
with the largest remaining gain get two-dimensional tables the same way. A
score is the sum of the looked-up values, so batches are scored by vectorised
additions.

Fitting takes a bounded sample: about SAMPLE labelled documents, drawn by a
hash of doc_id. Defined results: null or empty text has all-zero features and a
score like any other; repeated rows get equal scores; without labels of both
kinds every score is the share of label 1 (0.5 without labels); an empty table
gives an empty result; null labels are not learned; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sliced
from .language_id import _unit

#: Bound of the fit: labelled documents.
SAMPLE = 8_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS, PAIR_ROUNDS = 120, 60
LEARNING_RATE = 0.1
LEAVES = 3
THRESHOLD = 0.3

FEATURES = [
    "log_chars", "log_words", "word_length", "distinct_words", "next_word_equal", "top_word", "upper", "digits",
    "stops", "exclamations", "symbols", "bars", "blanks", "distinct_lines", "words_per_stop", "words_per_line",
]
PREDICTION = "doc_id long, held_out boolean, score double, predicted int"


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


_KINDS = np.stack([
    _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(".,;:?"), _table("!"), _table("#$%&*+/<=>@[\\]^_`{}~"),
    _table("|"), _table(" \t\n\x0b\x0c\r"),
], axis=1)


def features(text: str | None) -> list[float]:
    """The shape of a whole text, in the order of FEATURES."""
    text = text or ""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upper, digits, stops, shouts, symbols, bars, blanks = np.bincount(raw, minlength=256) @ _KINDS
    lead = raw == 0xC3  # two-byte Latin letters: capitals come first
    upper += int((lead[:-1] & (raw[1:] <= 0x9E)).sum())
    words = text.split()
    counts = Counter(words)
    n, size = max(1, len(words)), len(raw)
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(size), np.log1p(len(words)), (size - blanks) / n, len(counts) / n, sum(map(eq, words, words[1:])) / n,
        max(counts.values(), default=0) / n, upper / size, digits / size, stops / n, shouts / n, symbols / n, bars / n,
        blanks / size, len(set(lines)) / max(1, len(lines)), min(200.0, len(words) / (stops + shouts + 1)), min(400.0, len(words) / max(1, len(lines))),
    ]


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]  # per feature: inner bin edges
    tables: list[np.ndarray]  # per feature: value of each bin
    coarse: list[np.ndarray]  # per feature: bin -> coarse bin of the pair tables
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[at[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[self.coarse[a][at[:, a]], self.coarse[b][at[:, b]]]
        return 1 / (1 + np.exp(-total))


def _value(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most LEAVES leaves over ordered bins with gradient sums g and weights h: the value of each bin."""
    cuts = [0, len(g)]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) <= LEAVES:
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = _gain(G[m] - G[a], H[m] - H[a]) + _gain(G[b] - G[m], H[b] - H[m]) - _gain(G[b] - G[a], H[b] - H[a])
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = gain[k], int(m[k])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = _value(G[b] - G[a], H[b] - H[a])
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a table into four quarters: its gain and each cell's value."""
    G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    total, best, out = _gain(G[-1, -1], H[-1, -1]), 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            quarters = [
                (S[i, j], S[i, -1] - S[i, j], S[-1, j] - S[i, j], S[-1, -1] - S[i, -1] - S[-1, j] + S[i, j]) for S in (G, H)
            ]
            gain = sum(_gain(a, b) for a, b in zip(*quarters, strict=True)) - total
            if gain > best:
                v = [_value(a, b) for a, b in zip(*quarters, strict=True)]
                best, out = gain, np.zeros_like(g)
                out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on features x and labels y (0 or 1), in the given order."""
    k = len(FEATURES)
    p = float(y.mean()) if len(y) else 0.5
    base = float(np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [(np.arange(len(e) + 1) * PAIR_BINS) // (len(e) + 1) for e in edges]
    model = AdditiveModel(base, edges, tables, coarse, [], [])
    if not 0 < p < 1:
        return model
    at, total = model.bins(x), np.full(len(x), base)

    def gradient():
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = gradient()
            size = len(tables[j])
            step = LEARNING_RATE * _tree(np.bincount(at[:, j], g, size), np.bincount(at[:, j], h, size))
            tables[j] += step
            total += step[at[:, j]]
    low = np.stack([coarse[j][at[:, j]] for j in range(k)], axis=1)
    cell = {(a, b): low[:, a] * PAIR_BINS + low[:, b] for a in range(k) for b in range(a + 1, k)}

    def cross(pair):
        g, h = gradient()
        return _cross(*(np.bincount(cell[pair], s, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for s in (g, h)))

    model.pairs = sorted(sorted(cell, key=lambda pair: (-cross(pair)[0], pair))[:PAIRS])
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for pair, table in zip(model.pairs, model.pair_tables, strict=True):
            step = LEARNING_RATE * cross(pair)[1]
            table += step
            total += step.ravel()[cell[pair]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """A model of about ``sample`` labelled documents outside the held-out fold."""
    known = labels.filter((fold() != 0) & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") > 0).cast("int").alias("quality"))
    rate = sample / max(sample, known.count())
    pick = _unit("doc_id") < rate if rate < 1 else F.lit(True)
    texts = docs.filter((fold() != 0) & pick).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            x = feature_matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"]
            )

    rows = texts.join(known.filter(pick), "doc_id").mapInArrow(sliced(run), "doc_id long, quality int, x array<double>")
    rows = sorted((r["doc_id"], r["quality"], r["x"]) for r in rows.collect())
    return fit(np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            s = model.score(feature_matrix(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sliced(run), PREDICTION)


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that the model rejects, with the columns of docs."""
    columns = docs.columns

    def run(batches):
        for batch in batches:
            s = model.score(feature_matrix(batch.column(position).to_pylist()))
            yield batch.filter(pa.array(s >= threshold))

    position = columns.index("text")
    return docs.mapInArrow(sliced(run), docs.schema)
