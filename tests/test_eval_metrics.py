"""Evaluation and metric rules on hand-made edge rows."""

from feedlens.operators.evaluate import global_metrics, label_metrics
from feedlens.operators.metrics import avg_sentiment, daily_by_source


def py_macro(gold, pred):
    labels = sorted(set(gold) | set(pred))
    p, r, f = [], [], []
    for lab in labels:
        tp = sum(1 for g, q in zip(gold, pred) if g == q == lab)
        ps = sum(1 for q in pred if q == lab)
        ts = sum(1 for g in gold if g == lab)
        p.append(tp / ps if ps else 0.0)
        r.append(tp / ts if ts else 0.0)
        f.append(2 * tp / (ps + ts) if ps + ts else 0.0)
    acc = sum(1 for g, q in zip(gold, pred) if g == q) / len(gold)
    n = len(labels)
    return [round(acc, 4), round(sum(p) / n, 4), round(sum(r) / n, 4), round(sum(f) / n, 4)]


def test_macro_with_label_never_predicted(spark):
    gold = ["negative", "neutral", "positive", "positive", "neutral"]
    pred = ["negative", "negative", "positive", "negative", "negative"]
    df = spark.createDataFrame(list(zip(gold, pred)), "gold string, pred string")
    assert list(global_metrics(df).first()) == py_macro(gold, pred)
    lab = {r.label: r for r in label_metrics(df).collect()}
    assert lab["neutral"].precision == 0.0 and lab["neutral"].recall == 0.0


def test_a1_ignores_null_a4_counts_it(spark):
    import datetime as dt

    d = dt.datetime(2024, 1, 1)
    rows = [("c", "youtube", d, "positive"), ("c", "youtube", d, None), ("c", "youtube", d, "weird")]
    df = spark.createDataFrame(rows, "company string, source string, date timestamp_ntz, sentiment string")
    assert daily_by_source(df).first().daily_sentiment_score == 1.0
    tot = [r for r in avg_sentiment(df).collect() if r.source is None][0]
    assert tot.avg_sentiment == round(-1 / 3, 6)


def test_volume_counts_topics_with_empty_messages(spark):
    """A topic whose messages decoded to no rows is listed with 0 and has_data false."""
    from feedlens.operators.metrics import volume_by_topic

    msgs = spark.createDataFrame([("a", 3), ("a", 2), ("b", 0)], "topic string, n_rows int")
    got = {r.topic: (r.n_rows, r.has_data) for r in volume_by_topic(msgs).collect()}
    assert got == {"a": (5, True), "b": (0, False)}


def test_macro_with_label_never_gold_and_source_split(spark):
    gold = ["negative", "negative", "neutral", "neutral"]
    pred = ["positive", "negative", "neutral", "positive"]
    src = ["youtube", "youtube", "trustpilot", "trustpilot"]
    df = spark.createDataFrame(list(zip(gold, pred, src)), "gold string, pred string, source string")
    assert list(global_metrics(df).first()) == py_macro(gold, pred)
    by = {r.source: list(r)[1:] for r in global_metrics(df, ["source"]).collect()}
    assert by["youtube"] == py_macro(gold[:2], pred[:2])
    assert by["trustpilot"] == py_macro(gold[2:], pred[2:])
    assert set(by) == {"youtube", "trustpilot"}  # a source without labelled rows has no row
