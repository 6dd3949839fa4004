"""Readers for the input tables and the derived review view.

Every query in the library starts here: Parquet scans whose projections and
filters Catalyst pushes into the reader, so a query that needs three columns
reads three columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _when_source(doc_id: Column, k: int, value: Column) -> Column:
    return F.when(doc_id % 3 == k, value)


def reviews(spark: SparkSession, sf_dir: str, with_gold: bool = False) -> DataFrame:
    """Canonical wide review rows derived from ``documents`` (+ ``labels``).

    One sparse wide frame for all three sources (the canonical schema), with
    the per-source columns NULL where they do not apply. ``logit_*`` stand in
    for a model's output. ``gold_label`` (a human label, from ``labels``
    keyed by doc_id) is joined only when asked for: the evaluation jobs need
    it, and every other job then reads ``documents`` alone instead of moving
    review text through a join.
    """
    d = table(spark, sf_dir, "documents").alias("d")
    if with_gold:
        lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").alias("l")
        j = d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left")
        gold = (F.when(F.col("l.toxic") == 1, "negative").when(F.col("l.quality") == 1, "positive")
                .when(F.col("l.quality") == 0, "neutral"))
    else:
        j = d
        gold = F.lit(None).cast("string")
    doc_id, n_chars, lang = F.col("d.doc_id"), F.col("d.n_chars"), F.col("d.lang")
    date = F.expr(
        "CAST(DATE'2024-01-01' AS TIMESTAMP_NTZ) + "
        "make_dt_interval(CAST(d.doc_id % 29 AS INT), 0, CAST(d.doc_id % 1440 AS INT), 0)")
    return j.select(
        doc_id.cast("string").alias("id"),
        F.when(doc_id % 3 == 0, "trustpilot").when(doc_id % 3 == 1, "youtube")
        .otherwise("reddit").alias("source"),
        F.col("d.source").alias("company"),
        F.col("d.text").alias("text"),
        date.alias("date"),
        _when_source(doc_id, 0, (1 + (doc_id * 7) % 5).cast("int")).alias("stars"),
        _when_source(doc_id, 0, lang).alias("location"),
        _when_source(doc_id, 1, F.concat(F.lit("v"), (doc_id % 17).cast("string"))).alias("videoid"),
        _when_source(doc_id, 1, (n_chars % 101).cast("int")).alias("like_count"),
        _when_source(doc_id, 1, (n_chars % 13).cast("int")).alias("youtube_reply_count"),
        _when_source(doc_id, 2, F.concat(F.lit("sub_"), lang)).alias("subreddit"),
        _when_source(doc_id, 2, (n_chars % 211).cast("int")).alias("vote"),
        _when_source(doc_id, 2, (n_chars % 29).cast("int")).alias("reddit_reply_count"),
        ((n_chars % 7).cast("double") / 2).alias("logit_neg"),
        ((n_chars % 5).cast("double") / 2).alias("logit_neu"),
        ((n_chars % 11).cast("double") / 4).alias("logit_pos"),
        gold.alias("gold_label"),
    )


def scored(spark: SparkSession, sf_dir: str, with_gold: bool = False) -> DataFrame:
    """Reviews with a sentiment: model argmax for youtube/reddit, stars rule for trustpilot."""
    from feedlens.functions.score import logits_label, stars_sentiment

    r = reviews(spark, sf_dir, with_gold)
    return r.withColumn(
        "sentiment",
        F.when(F.col("source") != "trustpilot",
               logits_label(F.col("logit_neg"), F.col("logit_neu"), F.col("logit_pos")))
        .otherwise(stars_sentiment(F.col("stars"))),
    )
