"""Turning reviews into scored reviews.

Two paths:

* built-in scoring (the default, and the fixture's logits): pure Catalyst
  expressions, one projection, stays inside whole-stage codegen;
* a Python model (``factory``): only the rows that need it go through
  ``mapInPandas``. Catalyst plans a Python UDF under a CASE for *all* rows, so
  the frame is split by source, scored, and unioned back instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.functions.score import (
    SENTIMENTS, ScorerFactory, gated_sentiment, score_with_model, softmax_label,
    stars_sentiment, threshold_label,
)
from feedlens.operators.sentiment_model import SentimentModel

PROB_SCALE = 6


def _probs_to_columns(df: DataFrame) -> DataFrame:
    cols = [F.round(F.get(F.col("probabilities"), i), PROB_SCALE).alias(f"{x}_probability")
            for i, x in enumerate(SENTIMENTS)]
    return df.select(*[c for c in df.columns if c != "probabilities"], *cols)


def score_reviews(reviews: DataFrame, factory: ScorerFactory | SentimentModel | None = None) -> DataFrame:
    """P6 + P7: sentiment from the model for youtube/reddit, from stars for trustpilot.

    ``factory``: a fitted model, or a factory of a Python one; without it the input's logits are read.

    Output = input columns (minus logits) + sentiment + three probability
    columns (NULL for trustpilot).
    """
    keep = [c for c in reviews.columns if not c.startswith("logit_")]
    is_tp = F.col("source") == "trustpilot"
    if factory is None:
        sc = softmax_label(F.array("logit_neg", "logit_neu", "logit_pos"))
        out = reviews.select(
            *keep,
            F.when(is_tp, stars_sentiment(F.col("stars"))).otherwise(sc["sentiment"]).alias("sentiment"),
            F.when(~is_tp, sc["probabilities"]).alias("probabilities"))
        return _probs_to_columns(out)
    tp = reviews.filter(is_tp).select(
        *keep, stars_sentiment(F.col("stars")).alias("sentiment"),
        F.lit(None).cast(T.ArrayType(T.DoubleType())).alias("probabilities"))
    rest = reviews.filter(~is_tp).select(*keep)
    other = factory.apply(rest) if isinstance(factory, SentimentModel) else score_with_model(rest, "text", factory)
    return _probs_to_columns(tp.unionByName(other.select(*tp.columns)))


def stars_sentiment_table(reviews: DataFrame) -> DataFrame:
    """P5 as a query: the star rule on every trustpilot row."""
    return (reviews.filter(F.col("source") == "trustpilot")
            .select("id", "stars", stars_sentiment(F.col("stars")).alias("sentiment")))


def softmax_table(reviews: DataFrame) -> DataFrame:
    """T11 as a query: probabilities and label from the three logits of every row."""
    sc = softmax_label(F.array("logit_neg", "logit_neu", "logit_pos"))
    return _probs_to_columns(reviews.select("id", sc["probabilities"].alias("probabilities"),
                                            sc["sentiment"].alias("sentiment")))


def topic_scores(reviews: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stand-in zero-shot topic scores (entailment probabilities) from the fixture logits.

    The three logits, read as scores for product-feedback / video-feedback /
    other-comments, are what a zero-shot model would return per candidate label.
    """
    return reviews.select(
        "id", "company", "source", "text", "logit_neg", "logit_neu", "logit_pos", *keep,
        F.array(F.exp("logit_pos"), F.exp("logit_neu"), F.exp("logit_neg")).alias("topic_scores"),
        F.array(F.exp("logit_pos"), F.exp("logit_neu"), F.exp("logit_neg")).alias("sentiment_scores"))


# Candidate labels of the two zero-shot passes; the first of equal scores wins.
TOPIC_CANDIDATES = ["product-feedback", "video-feedback", "other-comments"]
SENTIMENT_CANDIDATES = ["positive", "neutral", "negative"]


def threshold_labels(reviews: DataFrame, topic_threshold: float = 0.45,
                     sentiment_threshold: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """label = argmax of normalised scores if it clears the threshold, else unknown."""
    ts = topic_scores(reviews, keep)
    return ts.select(
        "id", *keep,
        threshold_label(F.col("topic_scores"), TOPIC_CANDIDATES, topic_threshold).alias("topic"),
        threshold_label(F.col("sentiment_scores"), SENTIMENT_CANDIDATES, sentiment_threshold).alias("sentiment"))


def gated_labels(reviews: DataFrame, topic_threshold: float = 0.45, existing: str | None = None) -> DataFrame:
    """T9 + U4: topic first; only product feedback gets the sentiment model's label.

    U4: with ``existing`` naming a column of already assigned labels, rows
    that have one keep it (the labelling pass skips them).
    """
    keep = (existing,) if existing else ()
    lab = threshold_labels(reviews, topic_threshold, keep=keep)
    gated = gated_sentiment(F.col("topic"), F.col("sentiment"))
    if existing:
        gated = F.coalesce(F.col(existing), gated)
    return lab.select("id", "topic", gated.alias("sentiment"))
