import random

import numpy as np
import pyarrow as pa
import pytest

from covlens.llm.components import components
from covlens.llm.near_dedup import HASHES, MISSED, drop_near_duplicates, minhashes, missed, near_duplicates, shingle_sets, subkeys_for
from covlens.llm.words import word_hashes

from .brute import near, words
from .conftest import ODD


def test_word_hashes_follow_words():
    texts = ["a b  c", "", " \t", "A b\nc", "c" * 70_000, "é\x0bé x\x0c", "\xa0 no\x1cblank"]
    hashes, counts, starts, ends = word_hashes(pa.array(texts), fold_case=True)
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    raw = "".join(texts).encode()
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == flat
    lower = [w.replace("A", "a") for w in flat]
    assert len(set(hashes.tolist())) == len(set(lower))
    sliced, n, _, _ = word_hashes(pa.array(["skip me", *texts])[1:], fold_case=True)
    assert (sliced == hashes).all() and (n == counts).all()


def test_minhashes_estimate_similarity():
    shingles, counts = shingle_sets(pa.array([" ".join(map(str, range(1000))), " ".join(map(str, range(80, 1000)))]), 3)
    a, b = minhashes(shingles, counts)
    assert abs((a == b).mean() - 0.92) < 4 * (0.92 * 0.08 / HASHES) ** 0.5


def test_pairs_at_any_threshold_share_keys():
    assert subkeys_for(85) == 10 and subkeys_for(80) == 14
    for percent in (50, 70, 80, 85, 95):
        assert missed(percent, subkeys_for(percent)) <= MISSED
    shingles, counts = shingle_sets(pa.array([" ".join(map(str, range(1000)))]), 3)
    assert (minhashes(shingles, counts, 84)[:, :HASHES] == minhashes(shingles, counts)).all()


def test_components_of_stars_need_no_round(spark, monkeypatch):
    from covlens.llm import components as module

    kinds, stored = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, kind: kinds.append(kind) or stored(df, kind))
    links = spark.createDataFrame([(2, 1), (1, 3), (9, 5), (9, 5), (4, 4)], "a long, b long")
    assert {(r["id"], r["component"]) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (9, 5)}
    assert kinds == ["links", "least"]


def test_components_of_path_star_and_single(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 300), (7, 6), (7, 6)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


def _same(rows, got):
    want = near(rows, 3, 85)
    expected = sorted(((i, n, c) for (i, _), (n, c) in zip(rows, want, strict=True)), key=str)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == expected
    for r in got:
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_odd_rows(odd_docs):
    _same(ODD, near_duplicates(odd_docs, 3, 85).collect())


def test_empty(no_docs):
    assert near_duplicates(no_docs, 3, 85).count() == 0


@pytest.mark.parametrize("step", [1, 4])
def test_edited_copies_with_and_without_hub(make_docs, step):
    """Chains and stars of edited copies: links between copies run over different centres."""
    rng = random.Random(step)
    rows = []
    for g in range(6):
        base = [f"w{g}x{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((len(rows), " ".join(base)))
        text = base
        for _ in range(15):
            text = list(text if step == 1 else base)
            for _ in range(rng.randrange(1, 8)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50))) for i in range(40)]
    rng.shuffle(rows)
    _same(rows, near_duplicates(make_docs(rows), 3, 85).collect())


def test_stage_keeps_columns(odd_docs):
    kept = drop_near_duplicates(odd_docs)
    assert kept.schema == odd_docs.schema
    want = near(ODD, 5, 80)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(
        (i for (i, _), (_, c) in zip(ODD, want, strict=True) if i is None or i == c or c is None), key=str
    )


@pytest.mark.parametrize("first", [0, 1])
def test_one_id_with_two_texts_loses_no_link(make_docs, first):
    """Ten ids with two unlike texts each, and a near copy of either."""
    rng = random.Random(7)
    pairs = [[[f"p{i}t{j}w{rng.randrange(10**6)}" for _ in range(80)] for j in (0, 1)] for i in range(10)]
    rows = [(i, " ".join(texts[j])) for j in (first, 1 - first) for i, texts in enumerate(pairs)]
    rows += [(100 + 10 * i + j, " ".join([*texts[j][:-1], "end"])) for i, texts in enumerate(pairs) for j in (0, 1)]
    _same(rows, near_duplicates(make_docs(rows), 3, 85).collect())
    kept = drop_near_duplicates(make_docs(rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted([*range(10)] * 2)


def test_one_id_among_copies_of_other_texts(make_docs):
    """A row goes by its own text: the unlike text under the id of a duplicate stays."""
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    rows = [(1, base[0]), (5, base[0] + " more"), (5, base[1]), (9, base[1] + " more")]
    _same(rows, near_duplicates(make_docs(rows), 3, 85).collect())
    assert sorted((r["doc_id"], r["text"]) for r in drop_near_duplicates(make_docs(rows)).collect()) == [rows[0], rows[2]]


def test_common_line_and_chains(make_docs):
    """Most texts share a long line, so buckets hold unlike sets; chains run through them."""
    rng = random.Random(9)
    line = [f"common{i}" for i in range(60)]
    rows, text = [], []
    for i in range(160):
        if i % 8 == 0 or rng.random() < 0.3:
            text = [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 40))]
        else:
            text = [*text[:-1], f"o{rng.randrange(10**6)}"]
        rows.append((i, " ".join(line + text)))
    rng.shuffle(rows)
    _same(rows, near_duplicates(make_docs(rows), 3, 85).collect())


def test_full_sets_decide():
    a, _ = shingle_sets(pa.array(["x y z x y z"]), 3)
    assert len(np.unique(a)) == 3
