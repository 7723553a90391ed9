import hashlib
import re

import numpy as np

from covlens.llm.exact_dedup import build_hash, drop_exact_duplicates, exact_duplicates, find

from .conftest import ODD


def test_perfect_hash_is_minimal_and_checked():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 256, (5_000, 32), dtype=np.uint8)
    digests[10, 24:] = digests[11, 24:]  # equal in the hashed bytes, different digests
    sizes, bits, slot = build_hash(digests)
    assert sorted(slot) == list(range(len(digests)))
    slots = digests[np.argsort(slot)]
    assert (find(digests, sizes, bits, slots) == slot).all()
    others = rng.integers(0, 256, (5_000, 32), dtype=np.uint8)
    assert (find(others, sizes, bits, slots) == -1).all()


def _brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        group = [j for (j, _), u in zip(rows, norm, strict=True) if u == t]
        keep = min((j for j in group if j is not None), default=None)
        out.append((i, keep, len(group), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_odd_rows(odd_docs):
    got = exact_duplicates(odd_docs).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["digest"].hex()) for r in got), key=str) == sorted(_brute(ODD), key=str)
    groups = {bytes(r["digest"]) for r in got}
    assert sum(r["kept"] for r in got) == len(groups)  # one row of each group, though rows repeat
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_stage_keeps_columns(odd_docs):
    kept = drop_exact_duplicates(odd_docs)
    assert kept.schema == odd_docs.schema
    rows = kept.collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted([1, 3, 4, 6, 8, 9, 10, 11], key=str)
    assert all(r["_rid"] == "e" for r in rows)


def test_empty(no_docs):
    assert exact_duplicates(no_docs).count() == 0
    assert drop_exact_duplicates(no_docs).count() == 0


def test_hot_group(make_docs):
    rows = [(i, "hot  text" if i % 3 else f"text {i}") for i in range(600)]
    got = exact_duplicates(make_docs(rows)).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] % 3} == {(1, 400)}
    assert sum(r["kept"] for r in got) == 201
