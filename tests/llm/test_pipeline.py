"""The stages of the pipeline, each on its predecessor's rows, against brute force where it is exact."""

import hashlib

import corpus_pipeline
import pytest
import test_decontamination
import test_jaccard_join
from textloom.llm.common import written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], FOLDER), "step"))
    return frames


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_return_the_columns_of_documents(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.schema.simpleString() == steps[0].schema.simpleString()


def test_quality_keeps_what_its_operator_keeps(steps):
    from textloom.llm.quality import score_documents

    kept = {r.doc_id for r in score_documents(steps[0]).filter("kept").collect()}
    assert ids(steps[1]) == kept and 0 < len(kept) < steps[0].count()


def test_one_document_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert ids(steps[2]) == {component for _, _, component in test_jaccard_join.brute(rows)}


def test_contaminated_documents_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    found = test_decontamination.brute([(r.doc_id, r.text) for r in steps[2].collect()], items)
    assert ids(steps[3]) == {key for key, *_, bad in found if not bad}


def test_secrets_go_and_documents_stay(steps):
    from textloom.llm.secret_scan import base_matches

    before, after = ({r.doc_id: r for r in df.collect()} for df in steps[3:5])
    assert set(before) == set(after)
    for key, row in after.items():
        assert not base_matches(row.text) and row.n_chars == len(row.text)
        if "<secret>" not in row.text:
            assert row == before[key]


def test_all_remaining_tokens_are_packed(spark, steps):
    pieces = steps[5].toPandas()
    assert set(pieces.doc_id) == ids(steps[4])
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_run_gives_the_same_rows_again(spark, steps):
    def digest(df):
        return sorted(hashlib.sha256(str((r.doc_id, r.doc_tokens)).encode()).hexdigest() for r in df.collect() if r.start == 0)

    assert digest(corpus_pipeline.run(spark, FOLDER)) == digest(steps[5])
