import pytest

from covlens.llm.decontamination import READINGS, contaminated, core_words, drop_contaminated, template_words, value_words

from .conftest import ODD

ITEM = "A train leaves the old station at 9 and travels 240 km before Anna meets it, so how far did Anna walk in 3 hours when 240 km were left?"


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(0, ITEM), (1, "Short item of six words only."), (2, None), (3, ""), (1, "Short item of six words only.")]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, whash string")


def _found(docs, benchmark):
    return {(r["doc_id"], r["item_id"]) for r in contaminated(docs, benchmark).collect()}


def test_template(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("He saw Anna, and 3 hours later (she) paid $240.50... The end!",)], "text string")
    t, v = df.select(template_words(F.col("text")), value_words(F.col("text"))).first()
    assert t == ["he", "saw", "", "and", "", "", "later", "she", "paid", "", "the", "end"]
    assert v == ["he", "saw", "anna", "and", "3", "hours", "later", "she", "paid", "240.50", "the", "end"]


def test_copies_and_new_values(make_docs, benchmark):
    other = ITEM.replace("240", "815").replace("Anna", "Marta").replace("9", "11").replace("km", "miles")
    mixed = ITEM.replace("before Anna", "before Marta").replace("km were", "miles were").replace("travels 240", "travels 77")
    rows = [
        (1, f"Some words before. {ITEM} And some after."), (2, f"intro text {other}"), (3, "SHORT!! ITEM!! OF!! SIX!! WORDS!! ONLY."),
        (4, "A train leaves the old station and nothing else is alike in this text about a walk."), (5, f"start {mixed}"),
        (6, "this is a short item of six words only, is it not"), (7, "short item of six other words"),
    ]
    found = _found(make_docs(rows), benchmark)
    assert {(1, 0), (2, 0), (3, 1), (6, 1)} <= found
    assert not {d for d, _ in found} & {4, 7}
    shares = {r["doc_id"]: r["share"] for r in contaminated(make_docs(rows), benchmark, min_share=0.0).collect()}
    assert shares[5] < shares[2]  # windows whose slots are inconsistent do not count


def test_copies_in_other_case_and_lines(make_docs, benchmark):
    short = "Short item of six words only."
    lines = ITEM.replace("before Anna", "before\n Anna").replace("did Anna", "did\tAnna").replace("240 km", "240\r\nkm")
    rows = [(1, f"x {ITEM.upper()} y"), (2, f"x {ITEM.lower()} y"), (3, f"x {lines} y"), (4, f"x {ITEM.title()} y"), (5, f"he wrote {short.lower()} then left")]
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in contaminated(make_docs(rows), benchmark).collect()}
    assert found == {(1, 0): 1.0, (2, 0): 1.0, (3, 0): 1.0, (4, 0): 1.0, (5, 1): 1.0}


def test_names_at_sentence_starts_and_of_several_words(spark, make_docs):
    short = "Tom has 5 apples. Tom buys 3 more apples, then Tom eats 2 apples. How many are left for Tom?"
    place = "On a cold day in March the last train from Paris took nine hours to reach the sea near Berlin and came back."
    quoted = 'Asked who wrote it, she said: "Anna and (Peter) wrote it together over one long summer by the lake."'
    items = spark.createDataFrame([(0, short), (1, place), (2, quoted), (3, "Anna has 5 red pens.")], "item_id long, text string")
    rows = [
        (1, short.replace("Tom", "Marta").replace("5", "6")), (2, short.replace("Tom", "Mary Jane")), (3, "And so: " + short.replace("Tom", "Jim")),
        (4, place.replace("Paris", "New York City").replace("Berlin", "Los Angeles")), (5, "we know that on" + place[2:].replace("Paris", "Rome")),
        (6, quoted.replace("Anna", "Marta").replace("Peter", "John")), (7, 'he asked "Marta has 7 red pens" and left'), (8, "Tom Lee has 7 red pens."),
        (9, "Tom has 5 apples. How many oranges are left for Anna?"),
    ]
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in contaminated(make_docs(rows), items).collect()}
    assert set(found) == {(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 2), (7, 3), (8, 3)}
    assert all(share == 1.0 for share in found.values())


def test_one_word_edits(spark, make_docs):
    import random

    rng, words = random.Random(3), [a + b for a in "ba ke li mo nu".split() for b in "rat sel tig von pum dak".split()]
    items, docs = [], []
    for n in range(9, 41):
        item = [rng.choice(words) for _ in range(n)]
        item[n // 3] = "Anna"
        item[n // 2] = "17"
        items.append((n, " ".join(item)))
        for at in range(n):
            for kind, new in enumerate([["changed"], [], [item[at], "added"]]):
                text = " ".join(["so", "it", "begins:", *item[:at], *new, *item[at + 1:], "and", "ends"])
                docs.append((n * 1_000 + at * 10 + kind, text))
    items = spark.createDataFrame(items, "item_id long, text string")
    found = _found(make_docs(docs).repartition(4), items)
    assert {(d, d // 1_000) for d, _ in docs} - found == set()


def test_part_of_a_long_item(spark, make_docs):
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    items = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    rows = [(1, "x " + " ".join(words[40:53]) + " y"), (2, "x " + " ".join(words[40:52]) + " y"), (3, " ".join(words[:9] + ["x"] + words[50:60]))]
    assert _found(make_docs(rows), items) == {(1, 0)}


def test_core_is_read_alike_in_all_readings(spark, corpus):
    from pyspark.sql import functions as F

    odd = ["(Paris) Rome, a-Paris b \"Anna\" went 3 km -- then\t\n Jim's 19Paris Rome left.\U0001f600 So!", "a\U0001d400! b", "\ue003b c Anna d e", ""]
    texts = corpus.select("text").filter("text is not null").union(spark.createDataFrame([(t,) for t in odd], "text string"))
    for names in READINGS[1:]:
        t = template_words(F.col("text"), names)
        rows = texts.select(core_words(t).alias("core"), template_words(F.col("text"), None).alias("literal")).collect()
        assert all(f" {' '.join(r['core'])} " in f" {' '.join(r['literal'])} " for r in rows if r["core"])
    df = spark.createDataFrame([(["a", "\ue000", "b", "c", "\ue001"],), (["\ue000's", "\ue001"],), (["a", "b"],)], "t array<string>")
    assert [r[0] for r in df.select(core_words(F.col("t"))).collect()] == [["b", "c"], [], ["a", "b"]]


def test_windows_without_literal_words(spark, make_docs):
    items = spark.createDataFrame([(0, "Anna 5 km."), (1, ITEM)], "item_id long, text string")
    rows = [(1, "then Marta 7 miles"), (2, "nothing 7 here"), (3, ITEM.replace("Anna", "Marta")), (4, "anna 9 km")]
    assert _found(make_docs(rows), items) == {(1, 0), (3, 1), (4, 0)}


def test_odd_rows(odd_docs, benchmark):
    assert _found(odd_docs, benchmark) == set()
    kept = drop_contaminated(odd_docs, benchmark)
    assert kept.schema == odd_docs.schema and kept.count() == len(ODD)


def test_empty_tables(no_docs, make_docs, benchmark):
    assert _found(no_docs, benchmark) == set()
    assert _found(make_docs([(1, ITEM)]), benchmark.limit(0)) == set()


def test_corpus_against_plain_search(spark, corpus):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    exact = {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if r["text"] in t}
    found = _found(corpus, items)
    assert exact and exact <= found and len(found) <= len(exact) + 2
    assert {r["doc_id"] for r in drop_contaminated(corpus, items).collect()} == set(texts) - {d for d, _ in found}


def test_tables_are_not_python(no_docs, benchmark):
    plan = contaminated(no_docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_few_texts_meet_the_wanted_keys(spark):
    """A join with the wanted texts moves them and few others, null ids included."""
    from covlens.llm.decontamination import maybe_wanted

    docs = spark.range(20_000).selectExpr("nullif(id, 7) AS doc_id", "xxhash64(cast(id AS string)) AS th", "'text' AS text")
    wanted = docs.filter("doc_id % 400 = 0 or doc_id is null").select("doc_id", "th").localCheckpoint()
    got = {(r["doc_id"], r["th"]) for r in maybe_wanted(docs, wanted).collect()}
    assert {(r["doc_id"], r["th"]) for r in wanted.collect()} <= got
    assert len(got) < 2_000
    assert maybe_wanted(docs, wanted.limit(0)).isEmpty()
