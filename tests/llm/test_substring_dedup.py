import random

import pytest

from covlens.llm.substring_dedup import repeated_passages

from .brute import repeated
from .conftest import ODD


def _same(rows, df):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)
    assert got == sorted(repeated(rows, 35), key=str)


def test_odd_rows(odd_docs):
    _same(ODD, repeated_passages(odd_docs))


def test_empty(no_docs):
    assert repeated_passages(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_shared_passages(make_docs, seed):
    """Passages of 20 to 90 words set into documents, cut, overlapping, repeated in one document, and whole copies."""
    rng = random.Random(seed)
    passages = [[f"p{k}_{rng.randrange(10**6)}" for _ in range(rng.choice([20, 34, 35, 36, 60, 90]))] for k in range(12)]
    rows = []
    for i in range(150):
        text = [f"d{i}_{j}" for j in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(len(p))])
            at = rng.randrange(len(text) + 1)
            text[at:at] = p[a:rng.choice([len(p), len(p), len(p) - 1])]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(200, "la " * 300), (201, "la " * 40), (202, "le lo " * 100), (203, rows[3][1]), (204, rows[3][1]), (None, rows[4][1])]
    _same(rows, repeated_passages(make_docs(rows)))


def test_corpus(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    _same(rows, repeated_passages(corpus))
