"""Word hashes of whole texts by array operations: no Python work per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
#: A random value for each byte; case-folded: capitals A to Z as their small letters.
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RADIX = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_RADIX, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo 2^64, kept for the next chunk."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            known[filled:2 * filled] = known[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        _POWERS[base] = known
    return known[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each) of a string array without nulls."""
    if texts.type == pa.large_string():
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, words of each text, first byte and end byte of each word), over all texts in order.

    Words are the runs between ASCII white space; a text's end ends a word.
    """
    raw, offsets = buffers(texts)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), none, none
    inside = ~_BLANK[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    with np.errstate(over="ignore"):
        value = (_BYTE_FOLDED if fold_case else _BYTE)[raw] * _powers(_RADIX, len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        hashes = mix((total[ends] - total[starts]) * _powers(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return hashes, counts, starts, ends


def runs(counts: np.ndarray) -> np.ndarray:
    """The first place of each run in an array that holds the runs one after another."""
    return np.cumsum(counts) - counts
