"""Plan properties that matter at scale, read from the physical plans of the registered queries."""

import pytest

import __spark_entry__ as E
from conftest import SMALL

QUERIES = E.queries()
# these run a stream or write files while being built; their plans are covered by other tests
SIDE_EFFECTS = {"stream_ingest", "ngram_state", "stream_daily", "json_roundtrip", "json_write", "json_read",
                "doc_store"}
PLANNED = sorted(set(QUERIES) - SIDE_EFFECTS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cartesian_products(spark, name):
    p = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["ngram_top100", "top_bigrams", "quota_sample", "retrieve_topk",
                                  "cap_per_item", "newest_unseen"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    p = plan(QUERIES[name](spark, SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("name", ["daily_pivot", "avg_sentiment", "stars_matrix", "interactions_30d",
                                  "eval_by_source", "stratified_split"])
def test_metric_queries_do_not_read_text(spark, name):
    df = QUERIES[name](spark, SMALL)
    scans = [line for line in plan(df).splitlines() if "FileScan parquet" in line]
    assert scans and all("text:" not in line for line in scans)


def test_labels_joined_only_for_evaluation(spark):
    assert "labels.parquet" not in plan(QUERIES["daily_pivot"](spark, SMALL))
    assert "labels.parquet" in plan(QUERIES["eval_global"](spark, SMALL))
