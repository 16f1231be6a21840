import collections
import os

import pytest

import corpus_pipeline
from quillon import storage
from quillon.llm import language_id, mixing, secret_scan, simhash
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_near_duplicates import brute as kept_of_groups

SF = "/root/testdata/sf0.001"


def test_rows_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = language_id.fit(language_id.training_rows(docs))
    rows = [r for r in docs.collect() if not model.predict(r.text)[2]]
    stay = kept_of_groups([(r.doc_id, r.text) for r in rows])
    assert len(stay) < len(rows)
    rows = [r for r in rows if r.doc_id in stay]
    bad = {x[0] for x in contaminated([(r.doc_id, r.text) for r in rows], items) if x[4]}
    rows = [r for r in rows if r.doc_id not in bad]
    clean = {r.doc_id: secret_scan.redacted(r.text, secret_scan.find(r.text)) for r in rows}
    left = spark.createDataFrame([(r.doc_id, clean[r.doc_id], r.source) for r in rows], "doc_id bigint, text string, source string")
    want = collections.Counter()
    for r in mixing.mix_plan(left, ["doc_id"]).collect():
        want[r.doc_id, clean[r.doc_id]] += r["__qn_copies"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == +want
    assert bad


def left_in(folder):
    """Files below folder that hold anything."""
    return [f for at, _, files in os.walk(folder) for f in files if not f.startswith((".", "_"))]


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    """A shared folder that only the pipeline's own folders and checkpoints go to."""
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path / "shared"))
    checkpoints = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    yield tmp_path
    spark._jsc.sc().setCheckpointDir(checkpoints)


def test_only_the_result_is_left_of_a_run(spark, shared):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert len(os.listdir(shared / "shared")) == 1 and left_in(shared / "checkpoints") == []


@pytest.mark.parametrize("at", [0, 2, 4])
def test_nothing_is_left_of_a_failed_run(spark, shared, monkeypatch, at):
    def broken(spark, docs, sf_dir):
        simhash.grouped(docs).count()
        raise RuntimeError("lost")

    stages = list(corpus_pipeline.STAGES)
    stages[at] = ("broken", broken)
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF)
    assert left_in(shared) == []


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", "w"), (None, None, None), (2, "", "y"), (3, "other words here", "z"), (None, "a b c d", "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    kept = sorted((str(r.doc_id), r.text) for r in simhash.deduplicated(docs).collect())
    assert kept == [("1", "a b c d"), ("2", ""), ("3", "other words here")]
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
