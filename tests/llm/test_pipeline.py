"""The corpus pipeline: stages chain, take effect, keep columns, and leave clean documents."""

import pytest

import corpus_pipeline
from feedlens.llm import exact_dedup, jaccard_join, quality, windows
from .test_pairs import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_filter_stages_drop_what_their_operators_say(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    decided = [
        lambda d: {r.doc_id for r in quality.score(spark, d, labels).where("predicted = 1").collect()},
        lambda d: {r.doc_id for r in exact_dedup.exact_groups(spark, d).where("kept").collect()},
        lambda d: {r.doc_id for r in jaccard_join.jaccard_components(spark, d).where("doc_id = component_id").collect()},
    ]
    for (before, after), keeps in zip(stages, decided):
        assert after.columns == before.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} == keeps(before)
        assert after.exceptAll(before).count() == 0


def test_near_stage_leaves_one_of_each_brute_force_component(stages):
    before, after = stages[2]
    want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id for r in after.collect()} == want


def test_passage_stage_changes_only_documents_with_repeats(spark, stages):
    before, after = stages[3]
    cut = {r.doc_id for r in windows.passages(spark, before).select("doc_id").collect()}
    old, new = ({r.doc_id: r for r in d.collect()} for d in (before, after))
    assert old.keys() == new.keys() and after.columns == before.columns
    for i in old:
        assert (old[i] == new[i]) if i not in cut else len(new[i].text) < len(old[i].text) and new[i].n_chars == len(new[i].text)


def test_run_equals_the_stages(spark, stages):
    got, want = corpus_pipeline.run(spark, SF), stages[-1][1]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_stages_on_empty_and_odd_rows(spark, make):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", "en", None, 15), (4, "a " * 2000, "en", "s", None)]
    for docs in (make([], extra=False), spark.createDataFrame(rows, make([], extra=False).schema)):
        for _, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, SF)
        docs.count()
