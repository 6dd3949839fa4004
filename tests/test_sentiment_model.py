"""naive Bayes against a plain model; the looked-up and the joined path; the loop with a model."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from feedlens.functions.score import SENTIMENTS
from feedlens.functions.text import STOP_WORDS
from feedlens.operators.scoring import score_reviews
from feedlens.operators.sentiment_model import SentimentModel
from feedlens.sources.tables import scored

TRAIN = [("good good fine the", "positive"), ("good film", "positive"), ("bad film bad", "negative"), ("so so film", "neutral"),
         (None, "neutral"), ("", "positive"), ("ignored words", "unknown")]
ASK = [("1", "good"), ("2", "BAD, bad!"), ("3", "never seen"), ("4", None), ("5", ""), ("6", "film good bad"), ("7", "the and of"), ("8", "Good1 good " * 500)]


def words(text):
    cleaned = "".join(c for c in (text or "").lower() if c.isalpha() or c in " _")
    return [w for w in cleaned.split(" ") if w and w not in STOP_WORDS]


def plain(train):
    rows = [(words(t), s) for t, s in train if s in SENTIMENTS]
    counts = {s: Counter(w for ws, x in rows if x == s for w in ws) for s in SENTIMENTS}
    vocabulary = {w for c in counts.values() for w in c}
    weigh = lambda n, of: round(1e6 * math.log((n + 1) / of))
    weights = {w: [weigh(counts[s][w], sum(counts[s].values()) + len(vocabulary)) for s in SENTIMENTS] for w in vocabulary}
    return weights, [weigh(sum(x == s for _, x in rows), len(rows) + 3) for s in SENTIMENTS]


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    train = spark.createDataFrame(TRAIN, "text string, sentiment string")
    return SentimentModel.fitted(spark, train, str(tmp_path_factory.mktemp("m") / "model"))


def test_weights_equal_plain_counts(fitted):
    weights, priors = plain(TRAIN)
    got = {r.word: [r[s] for s in SENTIMENTS] for r in fitted.table.collect()}
    assert got.pop(None) == priors and got == weights


def test_both_paths_give_the_exact_sums(spark, fitted):
    ask = spark.createDataFrame([(i, t, 1) for i, t in ASK], "id string, text string, word int")
    joined = SentimentModel(fitted.table, broadcast_words=2)
    assert fitted.held() and joined.held() is None
    weights, priors = plain(TRAIN)
    for model in (fitted, joined):
        out = model.logits(ask.repartition(3))
        assert out.columns == ["id", "text", "word", "logits"]
        got = {r.id: [round(x * 1e6) for x in r.logits] for r in out.collect()}
        assert got == {i: [p + sum(weights[w][k] for w in words(t) if w in weights) for k, p in enumerate(priors)] for i, t in ASK}
    assert "MapInArrow" not in joined.logits(ask)._jdf.queryExecution().executedPlan().toString()
    label = {r.id: r.sentiment for r in fitted.apply(ask).collect()}
    assert label["1"] == "positive" and label["2"] == "negative" and label["8"] == "positive"
    assert fitted.apply(ask.limit(0)).count() == 0


def test_empty_training_set(spark, tmp_path):
    model = SentimentModel.fitted(spark, spark.createDataFrame([], "text string, sentiment string"), str(tmp_path / "m"))
    r = model.apply(spark.createDataFrame([("1", "x")], "id string, text string")).first()
    assert r.sentiment == "negative" and [round(p, 9) for p in r.probabilities] == [round(1 / 3, 9)] * 3


def test_learns_planted_words_and_texts_do_not_move(spark, tmp_path):
    rows = scored(spark, SMALL).select("id", "source", "company", "stars", "text").withColumn("k", F.col("id").cast("int") % 3)
    planted = rows.withColumn("text", F.concat("text", F.element_at(F.array(F.lit(" zzbad"), F.lit(" zzmid"), F.lit(" zzgood")), F.col("k") + 1)))
    labelled = planted.withColumn("sentiment", F.element_at(F.array(*map(F.lit, SENTIMENTS)), F.col("k") + 1))
    model = SentimentModel.fitted(spark, labelled.filter("id % 2 = 0"), str(tmp_path / "m"))
    probe = spark.createDataFrame([("a", "zzbad"), ("b", "zzmid"), ("c", "zzgood")], "id string, text string")
    assert {r.id: r.sentiment for r in model.apply(probe).collect()} == {"a": "negative", "b": "neutral", "c": "positive"}
    plan = score_reviews(planted.drop("k"), model)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange hash" not in plan


def test_no_map_of_words_by_text_for_a_large_model(spark):
    from feedlens.operators.sentiment_model import SentimentModel, fit

    rows = [(1, "good good day", "positive"), (2, "bad day", "negative"), (None, "good", "neutral"), (4, None, "neutral"), (5, "", "positive"), (6, "bad bad night bad", "negative")]
    df = spark.createDataFrame(rows, "id int, text string, sentiment string")
    model = fit(df).cache()
    small, large = ({r.id: r.logits for r in SentimentModel(model, m).logits(df).collect() if r.id} for m in (100, 0))
    assert small == large
    plan = SentimentModel(model, 0).logits(df)._jdf.queryExecution().executedPlan().toString()
    by_text = [x for x in plan.splitlines() if "HashAggregate(keys=[id" in x]
    assert by_text and not any("word" in x.split("functions")[0] for x in by_text)


def test_a_large_model_in_parts_keeps_rows_apart_and_words_packed(spark, monkeypatch, tmp_path):
    """A row for each text and part crosses the network, not one for each word; rows with the same id are told apart."""
    from feedlens.operators import sentiment_model as SM

    monkeypatch.setattr(SM, "PART_WORDS", 3)
    rows = [(str(i), " ".join(f"w{chr(97 + (i * j) % 26)}" for j in range(i)), SENTIMENTS[i % 3]) for i in range(60)]
    rows += [("7", "wb wc unknown", "neutral"), ("7", "wb wc unknown", "neutral"), (None, "we we", "positive"), (None, "wf", "negative"), ("61", None, "neutral")]
    df = spark.createDataFrame(rows, "id string, text string, sentiment string")
    table = SentimentModel.fitted(spark, df, str(tmp_path / "m")).table
    small, large = (sorted((r.id or "", r.text or "", r.logits) for r in SentimentModel(table, m).logits(df).collect()) for m in (1000, 0))
    assert small == large and len(large) == len(rows)
    plan = SentimentModel(table, 0).logits(df)._jdf.queryExecution().executedPlan().toString()
    assert "explode(filter" not in plan and SentimentModel(table, 0).parts() > 5
