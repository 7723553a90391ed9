import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from covlens.llm import pii

from .conftest import ODD

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15]
            if ok[kind]:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ ()0123459é\n", max_size=60))
def test_base_spans_follow_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_of_long_runs_are_fast():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_decode_is_the_best_path():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger.fresh(rng)
    tagger.p["trans"], tagger.p["start"] = rng.normal(size=(pii.TAGS, pii.TAGS)), rng.normal(size=pii.TAGS)
    scores = [rng.normal(size=(n, pii.TAGS)) for n in (1, 3, 4)]
    for e, path in zip(scores, tagger.decode(scores), strict=True):
        def value(tags, e=e):
            return tagger.p["start"][tags[0]] + sum(x[t] for x, t in zip(e, tags, strict=True)) + sum(tagger.p["trans"][a, b] for a, b in zip(tags, tags[1:], strict=False))

        assert tuple(path) == max(itertools.product(range(pii.TAGS), repeat=len(e)), key=value)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    tagger = pii.Tagger.fresh(rng)
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    x, y = rng.integers(30, 90, (2, 6)), rng.integers(0, pii.TAGS, (2, 6))

    def likelihood():
        total = 0.0
        for e, tags in zip(tagger.emissions(x).astype(float), y, strict=True):
            alpha, gold = e[0] + tagger.p["start"], e[0, tags[0]] + tagger.p["start"][tags[0]]
            for t in range(1, len(e)):
                gold += tagger.p["trans"][tags[t - 1], tags[t]] + e[t, tags[t]]
                alpha = e[t] + pii._logsumexp(alpha[:, None] + tagger.p["trans"], 0)
            total += gold - pii._logsumexp(alpha, 0)
        return total / len(x)

    for name, g in tagger.gradient(x, y).items():
        at = (x[0, 2], 3) if name == "embed" else tuple(rng.integers(0, n) for n in tagger.p[name].shape)
        old = tagger.p[name][at]
        tagger.p[name][at] = old + 1e-3
        up = likelihood()
        tagger.p[name][at] = old - 1e-3
        slope = (up - likelihood()) / 2e-3
        tagger.p[name][at] = old
        assert slope == pytest.approx(g[at], abs=1e-3)


def test_odd_rows(odd_docs):
    got = pii.find(odd_docs, pii.train(odd_docs)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ODD)
    assert all(r["spans"] == "" for r in got)


def test_empty(no_docs):
    assert pii.find(no_docs, pii.train(no_docs)).count() == 0


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = pii.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.find(docs, tagger).collect():
        want = plain(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert set(filter(None, pii.written(want).split(","))) <= set(r["spans"].split(","))
        if not re.search("[0-9@]", texts[r["doc_id"]]):
            assert r["spans"] == ""


def test_tagger_alone_finds_most_spans_of_other_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text rlike '[0-9@]'").orderBy("doc_id")
    texts = [r["text"] for r in docs.select("text").collect()]
    tagger = pii.fit(texts[:500])
    found = total = 0
    for text in texts[500:]:
        chars = pii.codes(text)
        parts = pii.stretches(chars)
        for (a, b), tags in zip(parts, tagger.decode(tagger.stretch_scores([chars[a:b] for a, b in parts])), strict=True):
            mine = {(k, a + s, a + e) for k, s, e in pii._runs(tags)}
            base = {s for s in pii.base_spans(text) if a <= s[1] and s[2] <= b}
            found, total = found + len(mine & base), total + len(base)
    assert total > 50 and found >= 0.85 * total


def test_long_stretches_in_bounded_parts(monkeypatch):
    """Parts cover a stretch once; a text cut into parts has the spans of its pieces; memory follows no text's length."""
    import tracemalloc

    from covlens.llm import pii

    for n in (1, pii.LONG, pii.LONG + 1, 3 * pii.LONG + 77):
        taken = [x for _, _, low, high in pii._parts(n) for x in range(low, high)]
        assert taken == list(range(n)) and all(a <= low and high <= b and b - a <= pii.LONG for a, b, low, high in pii._parts(n))
    tagger = pii.Tagger.fresh(np.random.default_rng(0))
    line = "call 49 170 5550199 or mail me, "
    whole = pii.all_spans([line * 2_000], tagger)
    monkeypatch.setattr(pii, "LONG", 1 << 30)
    once = pii.all_spans([line * 2_000], tagger)
    assert whole[0][0] == once[0][0]
    same = set(whole[0][1]) & set(once[0][1])
    assert len(same) >= 0.99 * max(len(whole[0][1]), len(once[0][1]))
    monkeypatch.undo()
    tracemalloc.start()
    pii.all_spans(["7 " * 150_000, *["x 1"] * 255], tagger)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
