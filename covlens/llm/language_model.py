"""Log-likelihood of whole documents under a gated recurrent language model.

Words are counted over all training documents by Spark. The WORDS - 1 most
frequent ones and the end token are the model's own words; any other word is of
the class ``rare``, inside which its probability follows from its count plus one
(all words that were never seen are one outcome). The output softmax is
factored: first the class, then the word among its class's, so one token costs
CLASSES plus a class's words instead of all words. Words are put into classes
by the square roots of their counts. Hence the score of a text is the logarithm of a probability,
whatever words it holds.

The network is a gated recurrent unit in numpy, trained by backpropagation
through windows of STEPS tokens, the state carried from window to window within
a document and cut from the gradient. Training is spread over the data: in each of
ROUNDS rounds, every task starts from the same parameters, learns from its
own share of the training documents (SHARE of them in all, told by a hash of
doc_id, so it grows with the table), and the parameters are averaged by the
tokens seen, FAN_IN at a time in tasks until FAN_IN or fewer are left. Scoring
runs many documents side by side, window by window, each from a zero state to
its end token.

The counts of the HEAD most frequent words go to all tasks; the other words of
the documents are joined with all counts by their 64-bit hashes (at a billion
different words, two share a hash with a probability of about 0.03).

Defined results: null or empty text, or text without words, is the end token
alone; a null doc_id is held out; rows with repeated ids are scored one by one;
without training documents all counts are zero and the network untrained;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .near_dedup import chunks
from .words import runs, word_hashes

#: The remainder of crc32(doc_id as text) modulo FOLDS that is held out.
FOLDS, HELD_OUT = 7, 2
#: Words of the model with the end token, their classes, and words whose counts all tasks hold.
WORDS, CLASSES, HEAD = 4_096, 64, 65_536
EMBED, HIDDEN = 16, 16
#: Tokens of a window, documents side by side in training and in scoring.
STEPS, TRAIN_LANES, LANES = 32, 64, 512
#: Training: rounds, the part of the training documents they learn from (all), step size, parameters averaged at once.
ROUNDS, SHARE, RATE, FAN_IN = 2, 1.0, 0.2, 16
#: Bytes of text hashed at once; distinct words that a task holds before it writes their counts.
CHUNK_BYTES, HELD_WORDS = 1 << 20, 500_000
#: Bytes of text whose documents are scored side by side.
BATCH_BYTES = 16 << 20
#: Exponents up to this in either direction are far from what 32-bit floats cannot hold.
CALM = 60
END = np.int64(-1)  # the end token's place among word hashes


def training(doc_id: str = "doc_id"):
    """True for the rows that are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS != HELD_OUT, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens with each text's end token, tokens of each text)."""
    hashes, counts, _, _ = word_hashes(texts, fold_case=True)
    return np.insert(hashes.view(np.int64), np.cumsum(counts), END), counts + 1


def _count_words(batches):
    held, size = [], 0

    def merged():
        words, where = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(where, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)

    for batch in batches:
        for _, texts in chunks(batch, CHUNK_BYTES):
            held.append(np.unique(_tokens(texts)[0], return_counts=True))
            size += len(held[-1][0])
            if size > HELD_WORDS:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD_WORDS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["word", "c"])
                    held, size = [], 0
    if held:
        words, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["word", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, count) over all training documents."""
    rows = docs.filter(training()).select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count_words, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent words by hash (ascending), their counts and model numbers (WORDS for none); classes' first numbers."""

    hashes: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    cuts: np.ndarray
    by_number: np.ndarray
    tokens: int
    distinct: int

    @staticmethod
    def of(counts: DataFrame, size: int = WORDS, classes: int = CLASSES, head: int = HEAD) -> Vocabulary:
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        top = counts.orderBy(F.desc("c"), "word").limit(head).toArrow()
        words, c = top.column("word").to_numpy().astype(np.int64), top.column("c").to_numpy().astype(np.int64)
        own = words[words != END][:size - 1]
        n = np.array([*c[words != END][:size - 1], *c[words == END]] + [0] * (END not in words), np.int64)
        own = np.append(own, END)
        order = np.argsort(-n, kind="stable")
        own, n = own[order], n[order]
        root = np.sqrt(n + 1.0)
        before = (np.cumsum(root) - root) / root.sum()
        cuts = np.unique(np.searchsorted(before, np.arange(classes) / classes))
        cuts = np.append(cuts[cuts < len(own)], len(own))
        number = {int(w): i for i, w in enumerate(own)}
        if END not in words:
            words, c = np.append(words, END), np.append(c, 0)
        by_hash = np.argsort(words)
        numbers = np.array([number.get(int(w), len(own)) for w in words[by_hash]], np.int64)
        return Vocabulary(words[by_hash], c[by_hash], numbers, cuts, n, int(total["n"]), int(total["v"]))

    @property
    def size(self) -> int:
        return len(self.by_number)

    @property
    def rare(self) -> tuple[int, int]:
        """(tokens, distinct words) of the training documents that are none of the model's words."""
        return self.tokens - int(self.by_number.sum()), self.distinct - int((self.by_number > 0).sum())

    @cached_property
    def table(self) -> tuple[np.int64, np.ndarray, int]:
        """(bits to shift by, first place in ``hashes`` of each value of the leading bits, most places of one value)."""
        bits = max(1, len(self.hashes).bit_length() + 1)
        edges = np.arange(-(1 << bits - 1), 1 << bits - 1, dtype=np.int64) << np.int64(64 - bits)
        first = np.append(np.searchsorted(self.hashes, edges), len(self.hashes))
        return np.int64(64 - bits), first, int(np.diff(first).max())

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(model number, count, whether the count is known here) of each token."""
        shift, first, most = self.table
        place = (tokens >> shift) + (len(first) >> 1)
        at = np.minimum(first[place], len(self.hashes) - 1)
        here = self.hashes[at] == tokens
        rest = np.flatnonzero(~here)
        for step in range(1, most):  # the next one of those with the same leading bits
            rest = rest[first[place[rest]] + step < first[place[rest] + 1]]
            own = first[place[rest]] + step
            same = self.hashes[own] == tokens[rest]
            at[rest[same]] = own[same]
            here[rest[same]] = True
            rest = rest[~same]
        return np.where(here, self.number[at], self.size), np.where(here, self.counts[at], 0), here


def fresh(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters that give each word its frequency whatever came before; input words have WORDS for any rare one."""
    rng, size = np.random.default_rng(seed), vocabulary.size
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    n, starts = vocabulary.by_number + 1.0, vocabulary.cuts[:-1]
    mass = np.append(np.add.reduceat(n, starts), vocabulary.rare[0] + 1.0)
    return {
        "embed": scale(size + 1, EMBED) * np.float32(np.sqrt(size + 1) / 2), "x": scale(EMBED, 3 * HIDDEN), "h": scale(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
        "cls": np.zeros((HIDDEN, len(mass)), np.float32), "cls_b": np.log(mass / mass.sum()).astype(np.float32),
        "out": np.zeros((size, HIDDEN), np.float32), "out_b": np.log(n).astype(np.float32),
    }


def _chosen(x: np.ndarray, rows: np.ndarray, at: np.ndarray, whole: bool, calm: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """(the negative softmax of the rows of x if asked, its logarithm at one place of each row); x is overwritten.

    Rows that are not ``calm`` are moved to a greatest value of 0 first."""
    if not calm:
        x -= x.max(1, keepdims=True)
    mine = x[rows, at].astype(np.float64)
    total = np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype)
    if whole:
        x *= (-1 / total)[:, None]
    return x if whole else None, mine - np.log(total.astype(np.float64))


def _order(numbers: np.ndarray, most: int) -> np.ndarray:
    """Places of numbers from 0 to ``most`` in ascending order, equal ones as they come (small integers are sorted by radix)."""
    return np.argsort(numbers.astype(np.min_scalar_type(most)), kind="stable")


def word_scores(p: dict, cuts: np.ndarray, states: np.ndarray, words: np.ndarray, grad: dict | None = None):
    """Natural log-probability of each word after its state; for a rare one, of being rare.

    With ``grad``, the gradient of their sum is added there, and that by the states returned as well.
    """
    group = np.searchsorted(cuts, words, "right") - 1  # the class after the last one: rare
    every, n = np.arange(len(words)), states.shape[1]
    # One more column, of ones, meets the biases.
    wide = np.concatenate([states, np.ones((len(states), 1), states.dtype)], 1)
    by_class, by_word = np.vstack([p["cls"], p["cls_b"]]), np.column_stack([p["out"], p["out_b"]])
    most = max(1, np.abs(states).max(initial=0)) * max(np.abs(by_class).sum(0).max(), (np.abs(by_word) @ np.ones(n + 1, by_word.dtype)).max())
    calm = bool(most < CALM)
    d, score = _chosen(wide @ by_class, every, group, grad is not None, calm)
    back = None
    if grad is not None:
        d[every, group] += 1
        step = wide.T @ d
        grad["cls"] += step[:n]
        grad["cls_b"] += step[n]
        back = d @ p["cls"].T
    # Word by word inside the classes of several: only products are formed class by class, the rows of all classes
    # lie one after another in ``flat``.
    order, low = _order(group, len(cuts)), cuts.tolist()
    ends = np.searchsorted(group[order], np.arange(len(cuts))).tolist()
    several = [c for c in range(len(low) - 1) if ends[c] < ends[c + 1] and low[c + 1] - low[c] > 1]
    if not several:
        return score, back
    order = np.concatenate([order[ends[c]:ends[c + 1]] for c in several])
    own, size = wide[order], np.diff(cuts)[group[order]]
    place = runs(size) + words[order] - cuts[group[order]]
    kind = np.result_type(states, by_word)
    flat, total, ones = np.empty(int(size.sum()), kind), np.empty(len(order), kind), np.ones(int(size.max()), kind)
    blocks, row, cell = [], 0, 0
    for c in several:
        to, last = row + ends[c + 1] - ends[c], cell + (ends[c + 1] - ends[c]) * (low[c + 1] - low[c])
        x = flat[cell:last].reshape(to - row, -1)
        np.matmul(own[row:to], by_word[low[c]:low[c + 1]].T, out=x)
        if not calm:
            x -= x.max(1, keepdims=True)
        blocks.append((x, slice(row, to), slice(low[c], low[c + 1])))
        row, cell = to, last
    mine = flat[place].astype(np.float64)
    np.exp(flat, out=flat)
    for x, rows, _ in blocks:
        np.matmul(x, ones[:x.shape[1]], out=total[rows])
    score[order] += mine - np.log(total.astype(np.float64))
    if grad is None:
        return score, back
    flat *= np.repeat(-1 / total, size)
    flat[place] += 1
    by_own, by_state = np.zeros_like(by_word), np.empty((len(order), n), kind)
    for x, rows, members in blocks:
        np.matmul(x.T, own[rows], out=by_own[members])
        np.matmul(x, p["out"][members], out=by_state[rows])
    grad["out"] += by_own[:, :n]
    grad["out_b"] += by_own[:, n]
    back[order] += by_state
    return score, back


def _by_gate(x: np.ndarray) -> np.ndarray:
    """(..., 3 x HIDDEN) as (3, ..., HIDDEN): update gate, reset gate, new state."""
    return np.ascontiguousarray(np.moveaxis(x.reshape(*x.shape[:-1], 3, HIDDEN), -2, 0))


def unroll(p: dict, inputs: np.ndarray, starts: np.ndarray, h: np.ndarray, keep: list | None = None):
    """(state before each token, state after the last one) of a window: inputs (3, steps, lanes, HIDDEN), starts: a document begins.

    ``keep`` gets the gates, the new states and the products of states and weights of all steps."""
    steps, lanes = inputs.shape[1:3]
    states = np.empty((steps + 1, lanes, HIDDEN), np.float32)
    states[0] = h
    held = steps if keep is not None else 1
    gates, news, products = (np.empty((*size, held, lanes, HIDDEN), np.float32) for size in ((2,), (), (3,)))
    weights, less, some, moved = _by_gate(p["h"]), -inputs[:2], starts.any(1).tolist(), np.empty((lanes, HIDDEN), np.float32)
    for t in range(steps):
        h, at = states[t], t % held
        if some[t]:
            h[starts[t]] = 0
        a, gate, new = products[:, at], gates[:, at], news[at]
        np.matmul(h, weights, out=a)
        np.subtract(less[:, t], a[:2], out=gate)
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        np.multiply(gate[1], a[2], out=new)
        new += inputs[2, t]
        np.tanh(new, out=new)
        np.subtract(h, new, out=moved)
        moved *= gate[0]
        np.add(new, moved, out=states[t + 1])
    if keep is not None:
        keep += [*gates, news, products[2]]
    return states[:-1], states[-1]


def gradient(p: dict, cuts: np.ndarray, words: np.ndarray, starts: np.ndarray, live: np.ndarray, h: np.ndarray):
    """(gradient of the log-probabilities' sum over a full window's tokens, state after it, sum of log-probabilities)."""
    grad, keep = {k: np.zeros_like(v) for k, v in p.items()}, []
    x = p["embed"][words]
    inputs = np.matmul(x.reshape(-1, EMBED), _by_gate(p["x"])) + _by_gate(p["b"])[:, None]
    states, after = unroll(p, inputs.reshape(3, *words.shape, HIDDEN), starts, h, keep)
    at = np.flatnonzero(live.ravel())
    flat = states.reshape(-1, HIDDEN)
    score, back = word_scores(p, cuts, flat[at], words.ravel()[at], grad)
    dstates = np.zeros_like(flat)
    dstates[at] = back
    dstates = dstates.reshape(states.shape)
    z, r, new, a = keep
    # By the sums of the new state and of both gates, and by what the reset gate lets through.
    d, dh = np.empty((len(words), 4, *h.shape), np.float32), np.zeros_like(h)
    by_state, by_new = (np.empty((len(words), 2, *h.shape), np.float32) for _ in range(2))
    by_state[:, 0], by_state[:, 1] = (1 - z) * (1 - new * new), (states - new) * z * (1 - z)
    by_new[:, 0], by_new[:, 1] = a * r * (1 - r), r
    da, back_h, some, before = np.empty((*words.shape, 3, HIDDEN), np.float32), np.ascontiguousarray(p["h"].T), starts.any(1).tolist(), np.empty_like(h)
    flat_da, turned = da.reshape(*words.shape, 3 * HIDDEN), d[:, 1:].transpose(0, 2, 1, 3)
    for t in range(len(words) - 1, -1, -1):
        np.multiply(dh, by_state[t], out=d[t, :2])
        np.multiply(d[t, 0], by_new[t], out=d[t, 2:])
        da[t] = turned[t]
        dh *= z[t]
        np.matmul(flat_da[t], back_h, out=before)
        dh += before
        dh += dstates[t]
        if some[t]:
            dh[starts[t]] = 0
    grad["h"] += flat.T @ flat_da.reshape(-1, 3 * HIDDEN)
    da[:, :, 2] = d[:, 0]
    flat = flat_da.reshape(-1, 3 * HIDDEN)
    grad["b"] += flat.sum(0)
    grad["x"] += x.reshape(-1, EMBED).T @ flat
    order = _order(words.ravel(), len(p["embed"]))
    held = words.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    grad["embed"][held[first]] = np.add.reduceat((flat @ p["x"].T)[order], first)
    for g in grad.values():
        g /= np.float32(STEPS * TRAIN_LANES)
    return grad, after, score.sum()


class Lanes:
    """Documents (numbers of tokens) laid out one after another in lanes of about equal length."""

    def __init__(self, counts: np.ndarray, lanes: int, shuffled: bool = False) -> None:
        queue = [(0, i, []) for i in range(min(lanes, max(1, len(counts))))]
        for doc in np.argsort(-counts, kind="stable").tolist():
            size, i, docs = queue[0]
            docs.append(doc)
            heapq.heapreplace(queue, (size + int(counts[doc]), i, docs))
        queue.sort(key=lambda lane: (-lane[0], lane[1]))
        if shuffled:  # else a lane's longest documents come first
            rng = np.random.default_rng(len(counts))
            queue = [(size, i, rng.permutation(docs).tolist()) for size, i, docs in queue]
        self.docs = np.array([d for _, _, docs in queue for d in docs], np.int64)  # in the lanes' order
        self.size = np.array([size for size, _, _ in queue], np.int64)
        self.first = runs(self.size)
        self.counts = counts[self.docs]
        #: Where each token of the lanes' order stands in the documents' order.
        self.source = np.repeat(runs(counts)[self.docs] - runs(self.counts), self.counts) + np.arange(int(counts.sum()))
        self.begins = np.zeros(len(self.source) + 1, bool)
        self.begins[runs(self.counts)] = True

    def windows(self, steps: int):
        """(lanes that still run, places of their next tokens, which of them exist) window by window."""
        for at in range(0, int(self.size.max(initial=0)), steps):
            running = int(np.searchsorted(-self.size, -at))
            place = np.arange(at, at + steps)[:, None]
            live = place < self.size[:running]
            yield running, np.where(live, self.first[:running] + place, len(self.source)), live


def _ids(batch: pa.RecordBatch, vocabulary: Vocabulary):
    """(model numbers, counts, whether known, hashes of the unknown, tokens of each text) over a batch."""
    ids, c, known, others, sizes = [], [], [], [], []
    for _, texts in chunks(batch, CHUNK_BYTES):
        tokens, n = _tokens(texts)
        number, count, here = vocabulary.look_up(tokens)
        ids.append(number.astype(np.int32))
        c.append(count)
        known.append(here)
        others.append(tokens[~here])
        sizes.append(n)
    return [np.concatenate(a) for a in (ids, c, known, others, sizes)]


def _gathered(batches):
    """Batches of about BATCH_BYTES of text: many documents run side by side."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def learn(p: dict, squares: dict, cuts: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> float:
    """Change the parameters by the documents, window by window; the sum of their log-probabilities before each change."""
    lanes, total = Lanes(counts, TRAIN_LANES, shuffled=True), 0.0
    words = np.append(ids[lanes.source], 0)
    h = np.zeros((len(lanes.size), HIDDEN), np.float32)
    for running, place, live in lanes.windows(STEPS):
        here = words[place]
        g, h, score = gradient(p, cuts, here, lanes.begins[place], live, h[:running])
        total += score
        met = np.zeros(len(p["embed"]), bool)
        met[here] = True
        for k, v in g.items():
            # Only the embeddings of the window's words have a gradient; the others stay as they are.
            rows = np.flatnonzero(met) if k == "embed" else slice(None)
            v = v[rows]
            step = v * v
            step += squares[k][rows]
            squares[k][rows] = step
            np.sqrt(step, out=step)
            step += np.float32(1e-6)
            np.divide(v, step, out=step)
            step *= np.float32(RATE)
            p[k][rows] += step
    return total


def scores(p: dict, cuts: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log-probability of each document's tokens; a rare word counts as being rare."""
    lanes = Lanes(counts, LANES)
    words = np.append(ids[lanes.source], 0)
    inputs = _by_gate(p["embed"] @ p["x"] + p["b"])
    h, out = np.zeros((len(lanes.size), HIDDEN), np.float32), np.zeros(len(words))
    for running, place, live in lanes.windows(STEPS):
        states, h = unroll(p, np.take(inputs, words[place], 1), lanes.begins[place], h[:running])
        at = place[live]
        out[at] = word_scores(p, cuts, states[live], words[at])[0]
    total = np.zeros(len(counts))
    total[lanes.docs] = np.add.reduceat(out, runs(lanes.counts)) if len(counts) else 0
    return total


def _pack(p: dict) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in sorted(p))


def _unpack(data: bytes, like: dict) -> dict:
    flat, out, at = np.frombuffer(data, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _mean(weights, blobs) -> bytes:
    total = sum(np.frombuffer(b, np.float32) * np.float64(w) for w, b in zip(weights, blobs, strict=True))
    return (total / sum(weights)).astype(np.float32).tobytes()


def averaged(parts: DataFrame) -> bytes | None:
    """The mean of the parameters (part, weight, p), FAN_IN at a time in tasks until FAN_IN or fewer are left."""

    def merge(table: pa.Table) -> pa.Table:
        w = table.column("weight").to_pylist()
        return pa.table({"part": [table.column("part")[0].as_py() // FAN_IN], "weight": [sum(w)], "p": pa.array([_mean(w, table.column("p").to_pylist())], pa.binary())})

    parts = stored(parts, "lm-parts")
    while (left := parts.agg(F.max("part")).first()[0]) is not None and left >= FAN_IN:
        group = F.floor(F.col("part") / FAN_IN).cast("long")
        parts = stored(parts.groupBy(group).applyInArrow(merge, "part long, weight double, p binary"), "lm-parts")
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    return _mean([r["weight"] for r in rows], [r["p"] for r in rows]) if rows else None


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, share: float = SHARE) -> dict[str, np.ndarray]:
    """The network's parameters after all rounds; each round learns from its own part of the training documents."""
    p = fresh(vocabulary)
    cell = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 20)) / (1 << 20)
    rows = docs.filter(training()).withColumn("cell", cell).select("cell", F.col("text").cast("string").alias("text"))

    def one_round(start: dict):
        def run(batches):
            from pyspark import TaskContext

            own = {k: v.copy() for k, v in start.items()}
            squares = {k: np.full_like(v, 1e-2) for k, v in own.items()}
            seen = 0
            for batch in _gathered(batches):
                ids, _, _, _, counts = _ids(batch, vocabulary)
                learn(own, squares, vocabulary.cuts, ids, counts)
                seen += len(ids)
            n = [TaskContext.get().partitionId()] if seen else []
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array([float(seen)][:len(n)], pa.float64()), pa.array([_pack(own)][:len(n)], pa.binary())], ["part", "weight", "p"])

        return run

    for i in range(rounds):
        mine = rows.filter((F.col("cell") >= share * i / rounds) & (F.col("cell") < share * (i + 1) / rounds)).select("text")
        mean = averaged(mine.mapInArrow(one_round(p), "part long, weight double, p binary"))
        p = p if mean is None else _unpack(mean, p)
    return p


def _scored(p: dict, vocabulary: Vocabulary):
    per_rare = np.log10(vocabulary.rare[0] + vocabulary.rare[1] + 1)
    per_token = np.log10(vocabulary.tokens + vocabulary.distinct + 1)

    def run(batches):
        for batch in _gathered(batches):
            ids, c, known, others, counts = _ids(batch, vocabulary)
            at, logs = runs(counts), np.log10(c + 1.0)
            rare = ids == vocabulary.size
            score = scores(p, vocabulary.cuts, ids, counts) / np.log(10)
            score += np.add.reduceat(np.where(rare, logs, 0), at) - np.add.reduceat(rare.astype(float), at) * per_rare
            base = np.add.reduceat(logs, at) - counts * per_token
            # Words whose counts are elsewhere, once per document.
            doc = np.repeat(np.arange(len(counts)), counts)[~known]
            order = np.lexsort((others, doc))
            doc, others = doc[order], others[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (others[1:] != others[:-1])])[:len(doc)])
            times = np.diff(np.append(first, len(doc)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(counts)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(a.astype(np.int64))) for a in (others[first], times)]
            known_tokens = np.add.reduceat((c > 0).astype(np.int64), at)
            columns = [batch.column("_rid"), batch.column("doc_id"), batch.column("held_out"), *(pa.array(a) for a in (counts, known_tokens, base, score)), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["_rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "others", "times"])

    return run


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (base-10 logarithms)."""
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id"), (~training()).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"_rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, others array<long>, times array<long>"
    own = stored(rows.mapInArrow(_scored(p, vocabulary), schema), "lm-scores")
    other = own.select("_rid", F.inline(F.arrays_zip(F.col("others").alias("word"), F.col("times").alias("times"))))
    met = other.join(counts, "word").groupBy("_rid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum("times").alias("more"))
    out = own.drop("others", "times").join(met, "_rid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Counts, network and scores of the same documents."""
    counts = stored(word_counts(docs), "lm-counts")
    vocabulary = Vocabulary.of(counts)
    return score(docs, counts, vocabulary, train(docs, vocabulary))
