"""The stages one by one on real tables, and on awkward documents."""

import re

import pytest

import corpus_pipeline
from cohortry.llm import decontamination, mixing, near_duplicates, toxicity
from tests.conftest import SMALL
from tests.llm.edges import awkward, nothing, same_schema
from tests.llm.test_near_duplicates import brute
from tests.llm.test_personal_data import brute as personal

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after each stage."""
    folder = tmp_path_factory.mktemp("stages")
    frames = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SMALL).write.parquet(f"{folder}/{name}")
        frames.append(spark.read.parquet(f"{folder}/{name}"))
    return dict(zip(["input", *[name for name, _ in corpus_pipeline.STAGES]], frames, strict=True))


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_order_and_columns(stages):
    assert list(stages) == [
        "input", "toxicity", "near_duplicates", "decontamination", "personal_data", "mixing",
    ]
    assert all(frame.columns == COLUMNS for frame in stages.values())


def test_toxicity_stage(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    graded = toxicity.graded_documents(stages["input"], labels)
    assert ids(stages["toxicity"]) == ids(graded.where("not rejected"))
    clean = ids(labels.where("toxic = 0").join(stages["input"], "doc_id"))
    assert len(set(clean) - set(ids(stages["toxicity"]))) <= 0.02 * len(clean)


def test_near_duplicate_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["toxicity"].collect()]
    assert ids(stages["near_duplicates"]) == sorted(set(brute(rows).values()))


def test_decontamination_stage(spark, stages):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    judged = decontamination.judged(stages["near_duplicates"], benchmark)
    assert ids(stages["decontamination"]) == ids(judged.where("not contaminated"))


def test_personal_data_stage(stages):
    before = {r["doc_id"]: r["text"] for r in stages["decontamination"].collect()}
    after = {r["doc_id"]: r for r in stages["personal_data"].collect()}
    assert before.keys() == after.keys()
    marks = re.compile(r"\[(?:email|ip|card|phone)\]")
    for doc_id, text in before.items():
        row = after[doc_id]
        assert personal(row["text"]) == [] and row["n_chars"] == len(row["text"] or "")
        if not personal(text) and not marks.search(row["text"] or ""):
            assert row["text"] == text


def test_mixing_stage(stages):
    planned = mixing.planned(stages["personal_data"])
    copies = {r["doc_id"]: r["count"] for r in stages["mixing"].groupBy("doc_id").count().collect()}
    for r in planned.collect():
        assert copies.get(r["doc_id"], 0) * r["size"] == r["taken"]


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, SMALL)
    assert sorted(found.collect(), key=str) == sorted(stages["mixing"].collect(), key=str)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_documents(spark, name, stage):
    docs = awkward(spark)
    result = stage(spark, docs, SMALL)
    assert same_schema(result, docs) and result.count() <= 33
    assert stage(spark, nothing(spark), SMALL).count() == 0


def test_stages_call_the_operators():
    assert near_duplicates.BANDS * near_duplicates.ROWS >= 40
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "mixing"
