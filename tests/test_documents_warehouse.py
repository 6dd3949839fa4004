"""Rejected documents, numbered payload batches and the co-located warehouse."""

import io

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from feedlens.operators import ingest as IN
from feedlens.operators import scoring as SC
from feedlens.operators import warehouse as WH
from feedlens.sources.documents import split_documents
from feedlens.sources.files import flatten_keyed, keyed_documents
from feedlens.sources.tables import reviews


def test_every_document_is_read_or_rejected_with_its_text(spark):
    docs = ['{"items": []}', '{"items": [{"snippet": null}]}', '{"items": {}}', '{"items": null}', '{"other": 1}', "[]", '"x"', "1", "null", "", "  ", None,
            '{"items": [', '{"items": [{"a": "b}]}', "{'items': []}", "not json", '{"items": []'] * 3
    df = spark.createDataFrame([(i, d, "mine") for i, d in enumerate(docs)], "i int, payload string, reason string")
    good, rejects = split_documents(df, "payload", "comments")
    assert good.columns == ["i", "payload", "reason"] and rejects.columns == ["i", "reason", "document"]
    reasons = {r.i: (r.reason, r.document) for r in rejects.collect()}
    kept = {r.i for r in good.collect()}
    assert kept | set(reasons) == set(range(len(docs))) and not kept & set(reasons)
    assert all(reasons[i][1] == docs[i] for i in reasons)
    first = [reasons[i][0] if i in reasons else "" for i in range(17)]
    assert first == ["", "", *["no $.items"] * 7, *["no document"] * 3, "malformed", "malformed", first[14], "malformed", "malformed"]
    assert first[14] in ("malformed", "no $.items")


def test_keyed_documents_hold_many_companies_and_comments(spark):
    rows = reviews(spark, SMALL).filter("source = 'youtube'").select("company", "text", "date", "videoid", F.lit("t").alias("topic"), F.lit("s").alias("sentiment"),
                                                                     (F.col("id").cast("int") % 5).alias("k"))
    docs = keyed_documents(rows, F.col("k"))
    assert docs.count() == 5
    flat = flatten_keyed(split_documents(docs, "doc", "keyed")[0])
    assert sorted((r.company, r.text) for r in flat.collect()) == sorted((r.company, r.text) for r in rows.collect())


def test_payload_batches_are_numbered_and_hold_all_rows_in_order(spark):
    rows = [("youtube", f"t{i}", None if i % 11 == 0 else f"c{i % 4}", "2024", i, None, None, None, None, None, None, None) for i in range(700)]
    wire = spark.createDataFrame(rows, IN.WIRE_SCHEMA).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")
    try:
        messages = IN.encode_payload(wire, max_rows=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for company in (None, "c0", "c1", "c2", "c3"):
        own = sorted((m for m in messages if m.topic == company), key=lambda m: m.batch)
        assert [m.batch for m in own] == list(range(len(own))) and [m.first_row for m in own] == [20 * m.batch for m in own]
        assert all(m.n_rows == 20 for m in own[:-1]) and 0 < own[-1].n_rows <= 20
        texts = [t for m in own for t in pq.read_table(io.BytesIO(m.payload))["text"].to_pylist()]
        assert texts == [r[1] for r in rows if r[2] == company]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wh"))
    return WH.store_warehouse(SC.score_reviews(reviews(spark, SMALL)), path, "feedlens_test_wh", buckets=4)


@pytest.mark.parametrize("source", sorted(WH.SATELLITES))
def test_detail_joins_need_no_exchange(spark, stored, source):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = WH.detail(stored, source)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        one = WH.detail(stored, source, "src0")
        assert "PartitionFilters: [isnotnull(company" in one._jdf.queryExecution().executedPlan().toString()
        assert df.count() == reviews(spark, SMALL).filter(F.col("source") == source).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_queries_share_one_warehouse(spark):
    from feedlens.plans.queries import _STORED, QUERIES

    QUERIES["wh_reddit"](spark, SMALL)
    before = dict(_STORED)
    QUERIES["reddit_detail"](spark, SMALL)
    assert _STORED == before and len({k for k in before if k[1] == SMALL and k[0] == spark.sparkContext.applicationId}) == 1
