import numpy as np

from covlens.llm import language_id, quality

from .conftest import ODD


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in language_id.predict(docs, language_id.train(docs)).collect() if r["held_out"]]
    assert len(held) > 150 and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in held)


def test_kernel_is_shared_ngrams():
    model = language_id.fit([("abab", "x"), ("cdcd", "y")])
    k = model.kernel(["ab", "cd", "zz"])
    assert k[0, 0] > 0 and k[0, 1] == 0 and k[1, 1] > 0 and (k[2] == 0).all()
    # "ab" has a, b, ab; "abab" has a, b, ab, ba, aba, bab.
    assert abs(k[0, 0] - 3 / np.sqrt(3 * 6)) < 1e-5


def test_language_of_odd_rows(odd_docs, make_docs, no_docs):
    model = language_id.fit([("the cat and the dog", "en"), ("der Hund und die Katze", "de")])
    got = language_id.predict(odd_docs, model).collect()
    assert len(got) == len(ODD)
    for r in language_id.predict(make_docs([(1, None), (2, "12 !?_"), (3, "")]), model).collect():
        assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language_id.train(odd_docs) is None  # no row has a language
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, None).collect()} == {"und"}
    assert language_id.predict(no_docs, language_id.train(no_docs)).count() == 0


def test_quality_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(4_000)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in quality.score(docs, quality.train(docs, labels)).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((3_000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (2, 5) in model.pairs
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.9


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, None), (4, 1), (5, 1), (7, 1), (None, 1), (8, 0)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    got = quality.score(odd_docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    kept = quality.keep_good(odd_docs, model)
    assert kept.schema == odd_docs.schema and kept.count() == sum(r["predicted"] for r in got)
    assert quality.score(no_docs, quality.train(no_docs, labels.limit(0))).count() == 0
    assert {r["score"] for r in quality.score(odd_docs, quality.train(odd_docs, labels.limit(0))).collect()} == {0.5}


def test_signs_of_numbers_are_no_letters():
    from covlens.llm.language_id import has_letter

    assert not any(map(has_letter, [None, "", "½ ² Ⅷ ①", "12 _ 3.", "½" * 10_000]))
    assert all(map(has_letter, ["½ a", "é", "我", "1 Ω"]))
