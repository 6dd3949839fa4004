"""Sentiment scoring expressions (all Catalyst built-ins) and the model hook.

Label order is fixed: index 0 = negative, 1 = neutral, 2 = positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label names in encoding order, and the topic labels.
SENTIMENTS = ["negative", "neutral", "positive"]
SOURCES = ["reddit", "trustpilot", "youtube"]
TOPIC_LABELS = ["product-feedback", "video-feedback", "other-comments", "unknown"]


def stars_sentiment(stars: Column) -> Column:
    """P5: more than 3 stars positive, exactly 3 neutral, anything else (NULL too) negative."""
    return F.when(stars > 3, "positive").when(stars == 3, "neutral").otherwise("negative")


def logits_label(neg: Column, neu: Column, pos: Column) -> Column:
    """Argmax over three scores with first-wins ties (negative before neutral before positive)."""
    return (F.when((neg >= neu) & (neg >= pos), "negative")
            .when(neu >= pos, "neutral").otherwise("positive"))


def softmax(logits: Column) -> Column:
    """Softmax of an array<double>, shifted by the max for stability."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def argmax(values: Column) -> Column:
    """0-based position of the first maximum of an array."""
    return F.array_position(values, F.array_max(values)) - 1


def label_of(index: Column, labels: list[str] = SENTIMENTS) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (index + 1).cast("int"))


def softmax_label(logits: Column, labels: list[str] = SENTIMENTS) -> Column:
    """struct<probabilities array<double>, sentiment string> from logits."""
    p = softmax(logits)
    return F.struct(p.alias("probabilities"), label_of(argmax(p), labels).alias("sentiment"))


def threshold_label(scores: Column, labels: list[str], threshold: float) -> Column:
    """Normalise scores to sum 1; argmax (first wins) if max > threshold else 'unknown'."""
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)
    norm = F.transform(scores, lambda x: x / total)
    return F.when(F.array_max(norm) > threshold, label_of(argmax(norm), labels)).otherwise("unknown")


def gated_sentiment(topic: Column, model_label: Column) -> Column:
    """Topic gating before sentiment.

    unknown topic stays unknown; other-comments and video-feedback become
    neutral; only product-feedback takes the model's label.
    """
    return (F.when(topic == "unknown", "unknown")
            .when(topic.isin("other-comments", "video-feedback"), "neutral")
            .otherwise(model_label))


# --- F1: pluggable model scorer ------------------------------------------------------------

ScorerFactory = Callable[[], Callable[[list[str]], list[list[float]]]]


def default_scorer_factory() -> Callable[[list[str]], list[list[float]]]:
    """Deterministic offline stand-in for a sentiment model: returns logits.

    Counts a few polarity cues; any real model (ONNX, torch) plugs in through
    the same factory signature and is loaded once per Python worker.
    """
    import re

    neg = re.compile(r"\b(bad|poor|worst|terrible|slow|broken|awful|hate)\b", re.I)
    pos = re.compile(r"\b(good|great|best|excellent|fast|love|nice|happy)\b", re.I)

    def score(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            t = t or ""
            n, p = len(neg.findall(t)), len(pos.findall(t))
            out.append([float(n), 0.5, float(p)])
        return out

    return score


def score_with_model(df: DataFrame, text_col: str = "text",
                     factory: ScorerFactory = default_scorer_factory,
                     batch_size: int = 64) -> DataFrame:
    """append ``probabilities`` and ``sentiment`` from a model run on the executors.

    ``mapInPandas`` keeps the model in the Python worker across Arrow batches
    (loaded once per worker, not once per batch) and feeds it ``batch_size``
    rows at a time.
    """
    import numpy as np

    out_schema = T.StructType(df.schema.fields + [
        T.StructField("probabilities", T.ArrayType(T.DoubleType())),
        T.StructField("sentiment", T.StringType()),
    ])

    def run(batches: Iterator):
        model = factory()
        for pdf in batches:
            texts = pdf[text_col].tolist()
            logits = []
            for i in range(0, len(texts), batch_size):
                logits.extend(model(texts[i:i + batch_size]))
            if logits:
                arr = np.asarray(logits, dtype="float64")
                arr = np.exp(arr - arr.max(axis=1, keepdims=True))
                arr = arr / arr.sum(axis=1, keepdims=True)
                pdf["probabilities"] = list(arr)
                pdf["sentiment"] = [SENTIMENTS[i] for i in arr.argmax(axis=1)]
            else:
                pdf["probabilities"] = []
                pdf["sentiment"] = []
            yield pdf

    return df.mapInPandas(run, out_schema)
