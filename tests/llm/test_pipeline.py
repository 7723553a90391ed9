import re

import corpus_pipeline
import pyarrow as pa
import pytest
from covlens.llm import common, packing
from covlens.llm.common import stored

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "test-stage"))
    return out


def test_stages_keep_the_columns(steps):
    for df in steps[:-1]:
        assert df.schema == steps[0].schema


def test_each_stage_against_brute_force(spark, steps):
    rows = [[(r["doc_id"], r["text"]) for r in df.collect()] for df in steps[:-1]]
    raw, good, exact, near, clean = rows
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in good}
    assert sum((i in kept) == bool(labels[i]) for i, _ in raw if i in labels) >= 0.95 * sum(i in labels for i, _ in raw)
    first = {}
    for i, t in sorted(good):
        first.setdefault(re.sub(brute.BLANK, " ", t), i)
    assert {i for i, _ in exact} == set(first.values())
    assert {i for i, _ in near} == {i for (i, _), (_, c) in zip(exact, brute.near(exact, 5, 80), strict=True) if i == c}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, t in near if any(x in t for x in items)}
    gone = {i for i, _ in near} - {i for i, _ in clean}
    assert leaked <= gone and len(gone) <= len(leaked) + 2
    pieces = steps[-1].collect()
    assert {p["doc_id"] for p in pieces} == {i for i, _ in clean}


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[-1].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_workers_give_back_what_they_freed(monkeypatch, make_docs):
    """At the end of a task and not before, by the operators' wrapper and by packing."""
    calls = []
    monkeypatch.setattr(common, "give_back", lambda plain=common.give_back: calls.append(plain()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5))], ["x"])
    task = common.sliced(lambda batches: batches, 2)(iter([batch]))
    assert next(task).num_rows == 2 and not calls
    assert sum(b.num_rows for b in task) == 3 and len(calls) == 1
    wrapped = []
    monkeypatch.setattr(packing, "lean", lambda run, plain=common.lean: wrapped.append(run) or plain(run))
    packing.pack(make_docs([]), "no tokenizer is read")
    assert len(wrapped) == 1
