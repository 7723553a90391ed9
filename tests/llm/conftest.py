from __future__ import annotations

import pytest

#: Rows that every operator must take: null and empty texts, white space only, repeated rows, ties, null ids.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (None, None), (6, "two  words"), (7, "two words"),
    (8, "x" * 30_000), (9, "word " * 8_000), (10, "Überraschung naïve ﬁn İstanbul \U0001f600 ok"), (11, "\x00 nul byte"),
]
#: Columns that clash with names that operators use themselves.
CLASHING = ["_rid", "n", "key", "cid", "node", "marks", "id", "th", "h1", "sig", "kept", "share", "whash", "bucket", "digest"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) rows, with clashing extra columns if asked."""

    def make(rows, extra=False):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, None, None, None) for i, t in rows]
        if extra:
            schema += "".join(f", {c} string" for c in CLASHING)
            full = [(*r, *("e" for _ in CLASHING)) for r in full]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD, extra=True)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def corpus(spark):
    """The documents of sf0.001 with their text, lang and labels."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
