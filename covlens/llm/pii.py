"""Personal data in texts: exact patterns, and spans added by a character BiLSTM with a CRF.

The patterns give the base spans (email, ip, card, phone). The tagger is a
bidirectional LSTM over characters whose emissions feed a linear-chain CRF,
trained in numpy on the base spans of a bounded sample of documents and on
variants of them that the patterns miss (a phone number without its plus sign,
a card number parted by dots). Every span of these kinds holds a digit or an
``@``; the tagger reads the stretches of text around such characters, in
overlapping windows whose emissions are blended by position, and each whole
stretch is decoded at once over the CRF's transitions. Stretches of more than
LONG characters (tables of numbers) are decoded in overlapping parts, each
position by the part in which it stands further inside, so memory does not
follow the longest one. A decoded span is added
if it overlaps no base span and the tagger is sure of it; base spans always stay.

Fitting takes about SAMPLE documents that hold a digit or an ``@``, drawn by a
hash of doc_id. Defined results: null or empty text has no spans; a null or
repeated doc_id is a row of its own; without documents to learn from nothing
is added; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .language_id import _unit

KINDS = ["email", "ip", "card", "phone"]
#: Bounds of the fit: documents and windows learned from, and gradient steps.
SAMPLE = 600
TRAIN_WINDOWS = 1_600
STEPS = 250
BATCH = 64
#: Characters of a window, its step, and how far a stretch reaches around a digit or ``@``.
WINDOW, STRIDE, MARGIN = 64, 32, 24
#: Characters of a stretch decoded at once, shared by two parts of a longer one, and (with padding) handled at once.
LONG, SHARED, AT_ONCE = 8_192, 256, 1 << 18
EMBED, HIDDEN = 12, 24
#: An added span: characters at least, and mean probability of its tags.
LEAST_CHARS, SURE = 7, 0.85

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_CHARS = 131  # ASCII, letters beyond, others beyond, padding

_TRIGGER = re.compile("[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and start, in one pass over the text for each kind."""
    out: list[Span] = []
    if _TRIGGER.search(text) is None:
        return out
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(m[0]) <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def codes(text: str) -> np.ndarray:
    """Character classes of a text: ASCII by value, letters and others beyond it."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    out = np.minimum(points, 129).astype(np.uint8)
    out[points == 128] = 129
    beyond = np.flatnonzero(points >= 128)
    if len(beyond):
        out[beyond[[text[i].isalpha() for i in beyond]]] = 128
    return out


def stretches(chars: np.ndarray) -> list[tuple[int, int]]:
    """The parts of a text within MARGIN characters of a digit or ``@``."""
    at = np.flatnonzero(((chars >= 48) & (chars <= 57)) | (chars == 64))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * MARGIN)
    firsts, lasts = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return [(max(0, int(a) - MARGIN), min(len(chars), int(b) + MARGIN + 1)) for a, b in zip(firsts, lasts, strict=True)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters by name: embedding, two LSTM directions, emission layer, CRF transitions and starts."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator) -> Tagger:
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"embed": scale(_CHARS, EMBED) * 3, "out": scale(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32)}
        for way in ("f", "b"):
            p |= {f"x{way}": scale(EMBED, 4 * HIDDEN), f"h{way}": scale(HIDDEN, 4 * HIDDEN), f"c{way}": np.zeros(4 * HIDDEN, np.float32)}
            p[f"c{way}"][HIDDEN:2 * HIDDEN] = 1  # remember at first
        return Tagger(p | {"trans": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)})

    def _direction(self, x: np.ndarray, way: str, keep: bool):
        """Hidden states (length, batch, HIDDEN) of one direction; with ``keep`` what its gradient needs."""
        steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        z = x @ self.p[f"x{way}"] + self.p[f"c{way}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), {}
        for t in steps:
            a = z[t] + h @ self.p[f"h{way}"]
            s = _sigmoid(a[:, :3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(a[:, 3 * HIDDEN:])
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            states[t] = h
            if keep:
                kept[t] = (i, f, o, g, tc, *before)
        return states, kept

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        """Tag scores (batch, length, TAGS) of windows of character classes."""
        x = self.p["embed"][windows.T]
        both = np.concatenate([self._direction(x, "f", False)[0], self._direction(x, "b", False)[0]], axis=2)
        return (both @ self.p["out"] + self.p["out_b"]).transpose(1, 0, 2)

    def gradient(self, windows: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean log-likelihood of the tags."""
        p, n = self.p, len(windows)
        x = p["embed"][windows.T]
        (sf, kf), (sb, kb) = self._direction(x, "f", True), self._direction(x, "b", True)
        both = np.concatenate([sf, sb], axis=2)
        e = both @ p["out"] + p["out_b"]  # length, batch, tags
        length = len(e)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0] + p["start"]
        for t in range(1, length):
            alpha[t] = e[t] + _logsumexp(alpha[t - 1][:, :, None] + p["trans"], 1)
        for t in range(length - 2, -1, -1):
            beta[t] = _logsumexp((beta[t + 1] + e[t + 1])[:, None, :] + p["trans"], 2)
        z = _logsumexp(alpha[-1], 1)
        gold = np.eye(TAGS, dtype=np.float32)[tags.T]
        de = (gold - np.exp(alpha + beta - z[None, :, None])) / n
        pairs = np.exp(alpha[:-1, :, :, None] + p["trans"] + (e + beta)[1:, :, None, :] - z[None, :, None, None])
        counts = np.zeros((TAGS, TAGS))
        np.add.at(counts, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        grad = {"trans": counts / n - pairs.sum((0, 1)) / n, "start": de[0].sum(0), "out": np.einsum("tbh,tbk->hk", both, de), "out_b": de.sum((0, 1))}
        dstates, dx = de @ p["out"].T, np.zeros_like(x)
        for way, kept, part in (("f", kf, dstates[:, :, :HIDDEN]), ("b", kb, dstates[:, :, HIDDEN:])):
            steps = range(length - 1, -1, -1) if way == "f" else range(length)
            dh = dc = np.zeros((n, HIDDEN), np.float32)
            da, hs = np.zeros((length, n, 4 * HIDDEN), np.float32), np.zeros((length, n, HIDDEN), np.float32)
            for t in steps:
                i, f, o, g, tc, h0, c0 = kept[t]
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                da[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                hs[t] = h0
                dc, dh = dc * f, da[t] @ p[f"h{way}"].T
            grad |= {f"x{way}": np.einsum("tbe,tbk->ek", x, da), f"h{way}": np.einsum("tbh,tbk->hk", hs, da), f"c{way}": da.sum((0, 1))}
            dx += da @ p[f"x{way}"].T
        grad["embed"] = np.zeros_like(p["embed"])
        np.add.at(grad["embed"], windows.T.ravel(), dx.reshape(-1, EMBED))
        return grad

    def stretch_scores(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Emissions of each stretch: overlapping windows blended by their distance from the window's ends."""
        cuts = [(k, a) for k, x in enumerate(parts) for a in range(0, max(1, len(x) - STRIDE), STRIDE)]
        sums = [np.zeros((len(x), TAGS), np.float32) for x in parts]
        weights = [np.zeros(len(x), np.float32) for x in parts]
        near = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1).astype(np.float32)
        for first in range(0, len(cuts), 512):
            group = cuts[first:first + 512]
            windows = np.full((len(group), WINDOW), _CHARS - 1)
            for row, (k, a) in zip(windows, group, strict=True):
                piece = parts[k][a:a + WINDOW]
                row[:len(piece)] = piece
            for e, (k, a) in zip(self.emissions(windows), group, strict=True):
                m = min(WINDOW, len(parts[k]) - a)
                sums[k][a:a + m] += near[:m, None] * e[:m]
                weights[k][a:a + m] += near[:m]
        return [s / w[:, None] for s, w in zip(sums, weights, strict=True)]

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag sequence of each whole stretch; stretches of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(scores)
        order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
        first = 0
        while first < len(order):
            group = order[first:first + max(1, AT_ONCE // max(1, len(scores[order[first]])))]  # padded to the longest
            first += len(group)
            length = len(scores[group[0]])
            e = np.zeros((length, len(group), TAGS), np.float32)
            sizes = np.array([len(scores[k]) for k in group])
            for j, k in enumerate(group):
                e[:sizes[j], j] = scores[k]
            best, back = e[0] + self.p["start"], np.zeros((length, len(group), TAGS), np.int8)
            for t in range(1, length):
                ways = best[:, :, None] + self.p["trans"]
                came = ways.argmax(1)
                new = np.take_along_axis(ways, came[:, None, :], 1)[:, 0] + e[t]
                live = (t < sizes)[:, None]
                back[t] = np.where(live, came, np.arange(TAGS))
                best = np.where(live, new, best)
            tag = best.argmax(1)
            path = np.zeros((length, len(group)), np.int8)
            for t in range(length - 1, -1, -1):
                path[t] = tag
                tag = back[t][np.arange(len(group)), tag]
            for j, k in enumerate(group):
                out[k] = path[:sizes[j], j]
        return out


def _runs(tags: np.ndarray) -> list[Span]:
    """(kind, first, end) of the tagged runs: a begin, or a change of kind, opens one."""
    out, first, kind = [], 0, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        k = (tag - 1) // 2
        if kind >= 0 and (k != kind or tag % 2 == 1):
            out.append((kind, first, i))
            kind = -1
        if tag and kind < 0:
            kind, first = k, i
    return out


def _parts(length: int) -> list[tuple[int, int, int, int]]:
    """(first, end, first and end of what is taken from it) of the parts in which a stretch is decoded."""
    if length <= LONG:
        return [(0, length, 0, length)]
    step, half = LONG - SHARED, SHARED // 2
    firsts = range(0, length - SHARED, step)
    return [(a, min(length, a + LONG), a + half if a else 0, a + step + half if a + LONG < length else length) for a in firsts]


def _tagged(stretches_of: list[np.ndarray], tagger: Tagger) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tags, their log-probabilities by the emissions) of each stretch, AT_ONCE characters at a time."""
    out = [(np.zeros(len(x), np.int8), np.zeros(len(x), np.float32)) for x in stretches_of]
    queue = [(k, *part) for k, x in enumerate(stretches_of) for part in _parts(len(x))]
    first = 0
    while first < len(queue):
        end, size = first, 0
        while end < len(queue) and (end == first or size + queue[end][2] - queue[end][1] <= AT_ONCE):
            size += queue[end][2] - queue[end][1]
            end += 1
        group = queue[first:end]
        scores = tagger.stretch_scores([stretches_of[k][a:b] for k, a, b, _, _ in group])
        for (k, a, _, low, high), tags, e in zip(group, tagger.decode(scores), scores, strict=True):
            mine = slice(low - a, high - a)
            out[k][0][low:high] = tags[mine]
            out[k][1][low:high] = e[mine][np.arange(high - low), tags[mine]] - _logsumexp(e[mine], 1)
        first = end
    return out


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each whole text."""
    base = [base_spans(t) for t in texts]
    found = [list(b) for b in base]
    if tagger is not None:
        where, parts, taken = [], [], {}
        for i, t in enumerate(texts):
            if _TRIGGER.search(t):
                chars = codes(t)
                taken[i] = np.zeros(len(chars), bool)  # by base spans
                for _, a, b in base[i]:
                    taken[i][a:b] = True
                for a, b in stretches(chars):
                    where.append((i, a))
                    parts.append(chars[a:b])
        for (i, a), (tags, logs) in zip(where, _tagged(parts, tagger), strict=True):
            for kind, first, end in _runs(tags):
                start, stop = a + first, a + end
                if end - first < LEAST_CHARS or taken[i][start:stop].any():
                    continue
                if np.exp(logs[first:end]).mean() >= SURE:
                    found[i].append((kind, start, stop))
    return [(b, sorted(f)) for b, f in zip(base, found, strict=True)]


def _examples(text: str, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of character classes and tags around the stretches of a text, and variants of them."""
    spans, chars = base_spans(text), codes(text)
    out = []

    def tagged(chars, spans):
        tags = np.zeros(len(chars), int)
        for kind, a, b in sorted(spans, key=lambda s: s[2] - s[1]):
            tags[a], tags[a + 1:b] = 2 * kind + 1, 2 * kind + 2
        for a, b in stretches(chars):
            first = a + int(rng.integers(0, max(1, b - a - WINDOW + 1)))
            window, tag = np.full(WINDOW, _CHARS - 1), np.zeros(WINDOW, int)
            piece = chars[first:first + WINDOW]
            window[:len(piece)], tag[:len(piece)] = piece, tags[first:first + WINDOW]
            out.append((window, tag))

    tagged(chars, spans)
    for kind, a, b in spans:
        low = max(0, a - MARGIN)
        piece = text[low:b + MARGIN]
        if kind == 3 and rng.random() < 0.5:  # the number without its plus sign
            tagged(codes(piece[:a - low] + piece[a - low + 1:]), [(3, a - low, b - low - 1)])
        if kind == 2 and rng.random() < 0.5 and b - a == 16:  # the card in groups parted by dots
            number = ".".join(text[a + i:a + i + 4] for i in range(0, 16, 4))
            tagged(codes(piece[:a - low] + number + piece[b - low:]), [(2, a - low, a - low + 19)])
    return out


def fit(texts: list[str], steps: int = STEPS) -> Tagger | None:
    """A tagger of the base spans of texts, in the given order; None without examples."""
    rng = np.random.default_rng(3)
    examples = [e for t in texts for e in _examples(t, rng)]
    if not examples:
        return None
    chosen = rng.permutation(len(examples))[:TRAIN_WINDOWS]
    x, y = (np.stack([examples[i][j] for i in chosen]) for j in (0, 1))
    tagger = Tagger.fresh(rng)
    mean, square = ({k: np.zeros_like(v) for k, v in tagger.p.items()} for _ in range(2))
    order = np.zeros(0, int)
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(x))])
        part, order = order[:BATCH], order[BATCH:]
        for k, g in tagger.gradient(x[part], y[part]).items():
            g = np.clip(g, -1, 1)
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            tagger.p[k] = (tagger.p[k] + 0.01 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A tagger learned from about ``sample`` documents that hold a digit or an ``@``."""
    known = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    rate = sample / max(sample, known.count())
    rows = (known.filter(_unit("doc_id") < rate) if rate < 1 else known).collect()
    return fit([r["text"] for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for base, every in all_spans(texts, tagger):
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return rows.mapInArrow(sliced(run), schema)
