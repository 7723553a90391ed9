"""Language identification with a blended-spectrum string kernel and Nystroem landmarks.

A text is the set of its character n-grams of length 1 to 3 (lower case,
hashed). The kernel of two texts is the number of n-grams in both over the
square root of the product of their set sizes, within a dictionary of the
landmarks' n-grams. With K the kernel among landmarks, a text's features are
its kernel values with them times K^(-1/2); one ridge regression per language
(one against the rest) is fitted on these, and whole batches are scored by
matrix products.

Fitting takes a bounded sample: about SAMPLE_PER_LANG labelled texts of each
language, drawn by a hash of doc_id. Defined results: null text or text
without a letter gives ``und`` with score 0, as does every text if nothing can
be learned from; repeated rows get equal results; an empty table gives an empty
result; null lang is never learned; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, sliced

#: Bounds of the fit: texts learned from and landmarks, for each language, and n-grams in the dictionary.
SAMPLE_PER_LANG = 300
LANDMARKS_PER_LANG = 24
DICTIONARY = 16_384
ORDERS = 3
HASH_BITS = 18
RIDGE = 1e-2
#: Texts scored by one matrix product, and their characters at most (a longer text goes alone).
BATCH_TEXTS, BATCH_CHARS = 128, 1 << 19
SHARPNESS = 6.0

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double"


def ngram_cells(text: str) -> np.ndarray:
    """The hashed n-grams of a text, with repeats."""
    with np.errstate(over="ignore"):
        chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
        out, code = [], np.zeros(len(chars), np.uint64)
        for n in range(1, ORDERS + 1):
            if len(chars) < n:
                break
            code = code[:len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1:]
            mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            out.append((mixed >> np.uint64(64 - HASH_BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class KernelModel:
    langs: list[str]
    cell_to_column: np.ndarray  # hashed n-gram -> dictionary column, or the last column for the rest
    landmarks: np.ndarray  # dictionary column x landmark, divided by the landmark's root size
    weights: np.ndarray  # landmark x language: K^(-1/2) times the ridge weights
    bias: np.ndarray

    def presence(self, texts: list[str]) -> np.ndarray:
        seen = np.zeros((len(texts), len(self.landmarks) + 1), bool)
        for row, text in zip(seen, texts, strict=True):
            row[self.cell_to_column[ngram_cells(text)]] = True
        return seen[:, :-1].astype(np.float32)

    def kernel(self, texts: list[str]) -> np.ndarray:
        seen = self.presence(texts)
        return seen @ self.landmarks / np.sqrt(np.maximum(seen.sum(1, keepdims=True), 1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its score among all languages."""
        raw = self.kernel(texts) @ self.weights + self.bias
        share = np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = raw.argmax(1)
        return [self.langs[i] for i in best], share[np.arange(len(best)), best].astype(float)


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter by its Unicode category: number signs such as a half or a Roman numeral are none."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def fit(rows: list[tuple[str, str]]) -> KernelModel | None:
    """The model of (text, lang) rows, in the given order; None without any."""
    rows = [(t, g) for t, g in rows if has_letter(t)]
    langs = sorted({g for _, g in rows})
    if not langs:
        return None
    chosen = [t for g in langs for t in [t for t, h in rows if h == g][:LANDMARKS_PER_LANG]]
    found = [np.unique(ngram_cells(t)) for t in chosen]
    counts = np.bincount(np.concatenate(found), minlength=1 << HASH_BITS)
    cells = np.argsort(-counts, kind="stable")[:min(DICTIONARY, int((counts > 0).sum()))]
    column = np.full(1 << HASH_BITS, len(cells), np.int32)
    column[cells] = np.arange(len(cells))
    marks = np.zeros((len(cells) + 1, len(chosen)), np.float32)
    for j, f in enumerate(found):
        marks[column[f], j] = 1
    marks = marks[:-1] / np.sqrt(np.maximum(marks[:-1].sum(0), 1))
    model = KernelModel(langs, column, marks, np.eye(len(chosen), dtype=np.float32), np.zeros(1, np.float32))
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    features = np.concatenate([model.kernel([t for t, _ in rows[i:i + BATCH_TEXTS]]) for i in range(0, len(rows), BATCH_TEXTS)]) @ root
    features = np.hstack([features, np.ones((len(rows), 1))])
    target = np.where(np.array([g for _, g in rows])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    ridge = RIDGE * np.eye(features.shape[1])
    ridge[-1, -1] = 1e-9
    solved = np.linalg.solve(features.T @ features / len(rows) + ridge / len(rows), features.T @ target / len(rows))
    model.weights, model.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)
    return model


def _unit(column: str) -> Column:
    """A number from 0 to 1 that a hash of the column settles."""
    return (F.xxhash64(F.lit(11), column) / F.lit(float(1 << 64)) + F.lit(0.5)).cast("double")


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> KernelModel | None:
    """A model of about ``per_lang`` texts of each language outside the held-out fold."""
    labelled = docs.filter((fold() != 0) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = [g for g, n in counts.items() if n <= per_lang]
    pick = F.col("lang").isin(rare)
    for g, n in counts.items():
        if n > per_lang:
            pick = pick | ((F.col("lang") == g) & (_unit("doc_id") < per_lang / n))
    rows = labelled.filter(pick).collect() if counts else []
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or "", r["lang"]))
    return fit([(r["text"], r["lang"]) for r in rows])


def _groups(texts: list[str]) -> Iterator[slice]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and (i - first >= BATCH_TEXTS or size + len(t) > BATCH_CHARS):
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if texts:
        yield slice(first, len(texts))


def predict(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""

    def run(batches):
        for batch in batches:
            ids, held = batch.column("doc_id"), batch.column("held_out")
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column("text").to_pylist()
            at = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            known = [texts[i] for i in at]
            for part in _groups(known):
                for i, lang, score in zip(at[part], *model.predict(known[part]), strict=True):
                    langs[i], scores[i] = lang, score
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sliced(run), PREDICTION)
