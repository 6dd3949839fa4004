"""What the loop holds on disk: bounded micro-batches, and n-gram state that is read without a shuffle."""

import glob

from pyspark.sql import functions as F

from conftest import SMALL
from feedlens.operators import ingest as IN
from feedlens.operators import ngrams as NG
from feedlens.plans import queries as Q
from feedlens.sources.files import scratch_path
from feedlens.sources.tables import reviews
from feedlens.streaming import pipeline as SP
from feedlens.streaming.state import DeltaState

KEYS = ["company", "n", "gram"]


def counted(df):
    return sorted((r["company"] or "", r["n"], r["gram"], r["count"]) for r in df.collect())


def test_a_landing_is_taken_in_bounded_micro_batches_and_goes_with_them(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(Q, "LANDED_ROWS", 20)
    monkeypatch.setattr(Q, "BATCH_BYTES", 1 << 10)
    seen = {}

    def file_source(s, landing, **options):
        seen.update(options, landing=landing)
        return real(s, landing, **options)

    real = SP.file_source
    monkeypatch.setattr(Q.SP, "file_source", file_source)
    monkeypatch.setattr(Q, "_model", lambda *a: Q.SentimentModel.fitted(spark, spark.createDataFrame([("good", "positive")], "text string, sentiment string"), str(tmp_path / "model")))
    base, state = Q._run_stream(spark, SMALL)
    path = base.removeprefix("file:")
    batches = glob.glob(f"{path}/out/warehouse/predictions/batch_id=*")
    assert len(batches) > 3 and seen["bytes_per_trigger"] >= 1 << 10
    assert spark.read.parquet(f"{base}/out/warehouse/predictions").count() == 200
    assert SP.stream_nulls(spark, f"{base}/out").first().n_rows == 200
    wire = IN.wire_rows(reviews(spark, SMALL)).distinct()
    assert counted(state.read()) == counted(NG.ngram_counts(wire.select("company", "text")))
    assert len(glob.glob(f"{seen['landing'].removeprefix('file:')}/*.parquet")) <= 200 / 20  # files of finished batches go, in the background


def test_state_is_read_and_folded_without_a_shuffle(spark):
    state = DeltaState(spark, scratch_path(spark, "packed"), KEYS)
    docs = [spark.createDataFrame([("a", "x y z x y"), ("b", "x  y z"), (None, "x y")], "company string, text string"),
            spark.createDataFrame([("a", "x y z q"), (None, "x y"), ("c", None)], "company string, text string")]
    state.write_delta(NG.ngram_counts(docs[0], parts=64), 0)  # packed where it is counted
    state.write_delta(NG.ngram_counts(docs[1]), 1)  # rows
    want = counted(NG.ngram_counts(docs[0].unionByName(docs[1])))
    got = state.read()
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert counted(got) == want
    state.compact()
    assert state._snapshot()[0] == 1 and counted(state.read()) == want
    assert {r.n: r.s for r in state.read().groupBy("n").agg(F.count("*").alias("s")).collect()} == {n: sum(w[1] == n for w in want) for n in {w[1] for w in want}}


def test_deltas_of_earlier_versions_are_read_as_rows(spark):
    state = DeltaState(spark, scratch_path(spark, "rows-state"), KEYS)
    spark.createDataFrame([("a", 1, "x", 2), ("a", 2, "x y", 1)], state.schema).write.parquet(f"{state.base}/deltas/batch_id=0")
    state.write_delta(spark.createDataFrame([("a", 1, "x", 3), ("a", 3, "x y z", 1)], state.schema), 1)
    want = [("a", 1, "x", 5), ("a", 2, "x y", 1), ("a", 3, "x y z", 1)]
    assert counted(state.read()) == want
    state.compact()
    assert counted(state.read()) == want


def test_a_model_is_broadcast_once_for_all_micro_batches(spark, tmp_path):
    model = Q.SentimentModel.fitted(spark, spark.createDataFrame([("good", "positive"), ("bad", "negative")], "text string, sentiment string"), str(tmp_path / "model"))
    rows = spark.createDataFrame([("1", "good"), ("2", "bad bad")], "id string, text string")
    first = {r.id: r.sentiment for r in model.apply(rows).collect()}
    sent = model._sent
    assert {r.id: r.sentiment for r in model.apply(rows).collect()} == first == {"1": "positive", "2": "negative"} and model._sent is sent
