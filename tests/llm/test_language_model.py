import math
import zlib
from collections import Counter

import numpy as np
import pytest
from covlens.llm import language_model as lm
from covlens.llm.common import stored

from . import brute
from .conftest import ODD

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _fold(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


def _counted(rows):
    counts, tokens = Counter(), []
    for doc_id, text in rows:
        own = [*brute.words((text or "").translate(LOWER)), None]  # None: the end
        tokens.append(own)
        if _fold(doc_id) not in (None, 2):
            counts.update(own)
    return counts, tokens


def _check_counts(rows, got):
    """Held-out mark, tokens, known tokens, training tokens and base score, as the contract states them."""
    counts, tokens = _counted(rows)
    n, v = sum(counts.values()), len(counts)
    want = []
    for (doc_id, _), own in zip(rows, tokens, strict=True):
        base = sum(math.log10((counts[t] + 1) / (n + 1 * (v + 1))) for t in own)
        want.append((doc_id, _fold(doc_id) in (None, 2), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6)))
    found = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_odd_rows(odd_docs):
    _check_counts(ODD, lm.score_documents(odd_docs).collect())


def test_empty(no_docs):
    assert lm.score_documents(no_docs).count() == 0


def test_nothing_to_learn_from(make_docs):
    held = [i for i in range(200) if _fold(i) == 2][:3]
    rows = [(held[0], "a b"), (held[1], None), (held[2], "A")]
    got = lm.score_documents(make_docs(rows)).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0), (2, 0, 0, 0.0)}


@pytest.fixture(scope="module")
def trained(corpus):
    docs = stored(corpus.select("doc_id", "text"), "lm-test")
    counts = stored(lm.word_counts(docs), "lm-test")
    vocabulary = lm.Vocabulary.of(counts, size=300, classes=12, head=600)
    p = lm.train(docs, vocabulary, share=0.8)
    return docs, counts, vocabulary, p


def test_counts_with_a_small_head(trained):
    """Most words' counts come by the join."""
    docs, counts, vocabulary, p = trained
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    _check_counts(rows, lm.score(docs, counts, vocabulary, p).collect())


def _plain(p, vocabulary, counts, ids, tokens):
    """log10 of the text's probability, one token after the other."""
    h, total, n = np.zeros(lm.HIDDEN), 0.0, 2 * lm.HIDDEN
    rare = vocabulary.rare
    for i, c in zip(ids, tokens, strict=True):
        group = int(np.searchsorted(vocabulary.cuts, i, "right")) - 1
        e = np.exp(h @ p["cls"] + p["cls_b"])
        total += math.log10(e[group] / e.sum())
        if i < vocabulary.size:
            a, b = vocabulary.cuts[group], vocabulary.cuts[group + 1]
            w = np.exp(p["out"][a:b] @ h + p["out_b"][a:b])
            total += math.log10(w[i - a] / w.sum())
        else:
            total += math.log10((c + 1) / (rare[0] + rare[1] + 1))
        x, u = p["embed"][i] @ p["x"] + p["b"], h @ p["h"]
        g = 1 / (1 + np.exp(-(x[:n] + u[:n])))
        z, r = g[:lm.HIDDEN], g[lm.HIDDEN:]
        h = (1 - z) * np.tanh(x[n:] + r * u[n:]) + z * h
    return total


def test_scores_are_those_of_the_network(trained):
    """Side by side and window by window gives what one token after the other gives, over whole documents."""
    docs, counts, vocabulary, p = trained
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    everything = {r["word"]: r["c"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, counts, vocabulary, p).collect()}
    import pyarrow as pa

    chosen = sorted(by_id, key=lambda i: len(by_id[i] or ""))
    for doc_id in [*chosen[:5], *chosen[90:110:4], chosen[-1]]:
        tokens, _ = lm._tokens(pa.array([by_id[doc_id] or ""]))
        ids, _, _ = vocabulary.look_up(tokens)
        want = _plain(p, vocabulary, counts, ids.tolist(), [everything.get(int(t), 0) for t in tokens])
        assert got[doc_id] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_probabilities_add_up(trained):
    _, _, vocabulary, p = trained
    words = np.arange(vocabulary.size + 1)
    h = np.tile(np.random.default_rng(0).standard_normal(lm.HIDDEN).astype(np.float32), (len(words), 1))
    score, _ = lm.word_scores(p, vocabulary.cuts, h, words)
    assert np.exp(score).sum() == pytest.approx(1, abs=1e-5)


def test_learning_helps_on_held_out_documents(trained):
    docs, counts, vocabulary, p = trained
    before, after = (
        sum(r["score"] for r in lm.score(docs, counts, vocabulary, q).collect() if r["held_out"]) for q in (lm.fresh(vocabulary), p)
    )
    base = sum(r["base_score"] for r in lm.score(docs, counts, vocabulary, p).collect() if r["held_out"])
    assert after > before > base * 1.2 and after > base


def test_gradient():
    rng = np.random.default_rng(0)
    n = np.array([50, 40, 30, 20, 10, 8, 5, 3, 2, 1])
    v = lm.Vocabulary(np.arange(10), n, np.arange(10), np.array([0, 2, 5, 10]), n, 200, 15)
    p = {k: a.astype(np.float64) + 0.1 * rng.standard_normal(a.shape) for k, a in lm.fresh(v).items()}
    words, starts, live = rng.integers(0, 11, (6, 4)), rng.random((6, 4)) < 0.2, rng.random((6, 4)) < 0.9
    h, scale = rng.standard_normal((4, lm.HIDDEN)), lm.STEPS * lm.TRAIN_LANES
    grad, _, _ = lm.gradient(p, v.cuts, words, starts, live, h)
    for k in p:
        at = (words[0, 0], 3) if k == "embed" else tuple(3 for _ in p[k].shape)
        two = []
        for step in (1e-3, -1e-3):
            q = {a: b.copy() for a, b in p.items()}
            q[k][at] += step
            two.append(lm.gradient(q, v.cuts, words, starts, live, h)[2])
        assert grad[k][at] * scale == pytest.approx((two[0] - two[1]) / 2e-3, rel=2e-3, abs=2e-3)


def test_average_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 2)
    parts = [(i, float(i + 1), np.full(3, i, np.float32).tobytes()) for i in range(7)]
    mean = np.frombuffer(lm.averaged(spark.createDataFrame(parts, "part long, weight double, p binary")), np.float32)
    assert mean == pytest.approx(sum(i * (i + 1) for i in range(7)) / 28)
    assert lm.averaged(spark.createDataFrame([], "part long, weight double, p binary")) is None


def test_every_training_document_is_learned_from(make_docs, monkeypatch):
    """The rounds' tasks see the tokens of all training documents, each once."""
    rows = [(i, f"w{i % 50} " * (1 + i % 7)) for i in range(400)]
    docs = stored(make_docs(rows), "lm-test")
    vocabulary = lm.Vocabulary.of(stored(lm.word_counts(docs), "lm-test"))
    seen = []

    def averaged(parts, plain=lm.averaged):
        parts = stored(parts, "lm-test")
        seen.extend(r["weight"] for r in parts.collect())
        return plain(parts)

    monkeypatch.setattr(lm, "averaged", averaged)
    lm.train(docs, vocabulary)
    assert sum(seen) == vocabulary.tokens


def test_word_scores_and_gradient_at_any_size_of_the_weights():
    """Weights that 32-bit exponentials cannot hold score like small ones; each word's gradient is that of its softmax."""
    rng, cuts = np.random.default_rng(3), np.array([0, 1, 4, 9])
    states, words = np.tanh(rng.standard_normal((40, lm.HIDDEN))).astype(np.float32), rng.integers(0, 10, 40)
    group = np.searchsorted(cuts, words, "right") - 1
    for size in (0.5, 200):
        p = {"cls": (lm.HIDDEN, 4), "cls_b": (4,), "out": (9, lm.HIDDEN), "out_b": (9,)}
        p = {k: (size * rng.standard_normal(shape)).astype(np.float32) for k, shape in p.items()}
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        score, back = lm.word_scores(p, cuts, states, words, grad)
        wide = {k: v.astype(np.float64) for k, v in p.items()}
        x = states @ wide["cls"] + wide["cls_b"]
        x -= x.max(1, keepdims=True)
        soft = np.exp(x) / np.exp(x).sum(1, keepdims=True)
        expected = x[np.arange(40), group] - np.log(np.exp(x).sum(1))
        for i, (g, w) in enumerate(zip(group, words, strict=True)):
            if g < 3:
                y = wide["out"][cuts[g]:cuts[g + 1]] @ states[i] + wide["out_b"][cuts[g]:cuts[g + 1]]
                expected[i] += y[w - cuts[g]] - y.max() - np.log(np.exp(y - y.max()).sum())
        assert np.allclose(score, expected, rtol=1e-4, atol=1e-3)
        assert np.allclose(grad["cls_b"], (np.eye(4)[group] - soft).sum(0), atol=1e-2)
        assert np.isfinite(back).all() and all(np.isfinite(g).all() for g in grad.values())


def test_calm_rows_are_not_moved():
    """Rows that no exponential can overflow are left where they are: one pass over the scores less."""
    x = np.array([[1.0, 2.0, 4.0]], np.float32)
    soft, logs = lm._chosen(x.copy(), np.array([0]), np.array([1]), True, True)
    moved, same = lm._chosen(x.copy(), np.array([0]), np.array([1]), True, False)
    assert np.allclose(soft, moved) and np.allclose(soft.sum(), -1) and np.allclose(logs, same)


def test_words_are_scored_without_a_softmax_for_each_class(monkeypatch):
    """One softmax over the classes and one pass over all classes' words, whatever the number of classes."""
    rng, cuts, calls = np.random.default_rng(4), np.arange(0, 61, 3), []
    states, words = rng.standard_normal((200, lm.HIDDEN)).astype(np.float32), rng.integers(0, 61, 200)
    p = {"cls": (lm.HIDDEN, 21), "cls_b": (21,), "out": (60, lm.HIDDEN), "out_b": (60,)}
    p = {k: rng.standard_normal(shape).astype(np.float32) for k, shape in p.items()}
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    monkeypatch.setattr(lm, "_chosen", lambda *a, plain=lm._chosen: calls.append(1) or plain(*a))
    score, back = lm.word_scores(p, cuts, states, words, grad)
    assert len(calls) == 1
    expected, by_state, by_word = np.zeros(200), np.zeros(states.shape), np.zeros(p["out"].shape)
    for i, w in enumerate(words.tolist()):
        softs = [(states[i] @ p["cls"] + p["cls_b"], w // 3, p["cls"].T)]
        if w < 60:
            own = p["out"][w // 3 * 3:w // 3 * 3 + 3]
            softs.append((own @ states[i] + p["out_b"][w // 3 * 3:w // 3 * 3 + 3], w % 3, own))
        for k, (x, at, rows) in enumerate(softs):
            d = -np.exp(x) / np.exp(x).sum()
            expected[i] += np.log(-d[at])
            d[at] += 1
            by_state[i] += d @ rows
            if k:
                by_word[w // 3 * 3:w // 3 * 3 + 3] += d[:, None] * states[i]
    assert np.allclose(score, expected, atol=1e-3)
    assert np.allclose(back, by_state, atol=1e-3) and np.allclose(grad["out"], by_word, atol=1e-3)


def test_look_up_of_words_that_share_their_leading_bits():
    hashes = np.sort(np.concatenate([np.arange(5), [-1, 1 << 62, (1 << 62) + 1, -(1 << 63), (1 << 63) - 1]]))
    v = lm.Vocabulary(hashes, np.arange(10) + 1, np.arange(10), np.array([0, 10]), np.arange(10) + 1, 55, 10)
    tokens = np.concatenate([hashes[::-1], [5, -2, (1 << 62) + 2, 1 << 40, (1 << 63) - 2]])
    number, count, here = v.look_up(tokens)
    assert number.tolist() == [*range(9, -1, -1)] + [10] * 5
    assert count.tolist() == [*range(10, 0, -1)] + [0] * 5 and here.tolist() == [True] * 10 + [False] * 5
