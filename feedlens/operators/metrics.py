"""Dashboard metrics over scored reviews (one DataFrame function per question).

Every function takes the scored review frame and answers for all companies at
once (``company`` is a grouping column); ``for_company`` narrows it with a
column predicate that Parquet pushdown turns into a scan filter.

Design notes for scale: every metric is one ``groupBy`` (map-side partial
aggregation, one exchange on the group key). Pivots and zero-filled matrices
are written as conditional aggregation inside that single group-by followed by
``unpivot`` on the (small) per-group result, so no domain cross join and no
second shuffle is needed.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.score import SENTIMENTS, SOURCES
from feedlens.operators.parallel import small_table

SCALE = 6  # averages are rounded to 6 digits


def for_company(df: DataFrame, company: str | None) -> DataFrame:
    """Company filter (a column predicate, never string-built SQL)."""
    return df if company is None else df.filter(F.col("company") == F.lit(company))


def day(col: str = "date") -> Column:
    return F.to_date(F.col(col))


def score_a1(sentiment: Column) -> Column:
    """A1 rule: +1 / -1 / 0; any other value, NULL included, is ignored (NULL)."""
    return (F.when(sentiment == "positive", 1).when(sentiment == "negative", -1)
            .when(sentiment == "neutral", 0))


def score_a4(sentiment: Column) -> Column:
    """A4 rule: positive 1, neutral 0, anything else (NULL included) -1."""
    return F.when(sentiment == "positive", 1).when(sentiment == "neutral", 0).otherwise(-1)


def _avg(c: Column) -> Column:
    return F.round(F.avg(c), SCALE)


def daily_by_source(scored: DataFrame, company: str | None = None) -> DataFrame:
    """A1: mean daily sentiment per (company, day, source)."""
    return (for_company(scored, company)
            .groupBy("company", day().alias("day"), F.lower("source").alias("source"))
            .agg(_avg(score_a1(F.col("sentiment"))).alias("daily_sentiment_score")))


def daily_pivot(scored: DataFrame, company: str | None = None) -> DataFrame:
    """A2: one row per (company, day), a column per source, NULL when absent; by date."""
    s = score_a1(F.col("sentiment"))
    src = F.lower(F.col("source"))
    return (for_company(scored, company)
            .groupBy("company", day().alias("day"))
            .agg(*[_avg(F.when(src == x, s)).alias(x) for x in SOURCES])
            .orderBy("company", "day"))


def daily_overall(scored: DataFrame, company: str | None = None) -> DataFrame:
    """A3: daily mean over all sources, sorted by date."""
    return (for_company(scored, company)
            .groupBy("company", day().alias("day"))
            .agg(_avg(score_a1(F.col("sentiment"))).alias("score"))
            .orderBy("company", "day"))


def daily_series_long(scored: DataFrame, company: str | None = None) -> DataFrame:
    """The dashboard series in long form (main + one per source), NULL points dropped."""
    s = score_a1(F.col("sentiment"))
    src = F.lower(F.col("source"))
    wide = (for_company(scored, company)
            .groupBy("company", day().alias("day"))
            .agg(_avg(s).alias("main"), *[_avg(F.when(src == x, s)).alias(x) for x in SOURCES]))
    long = wide.unpivot(["company", "day"], ["main", *SOURCES], "series", "score")
    return long.filter(F.col("score").isNotNull())


def mean_of_daily(scored: DataFrame, company: str | None = None) -> DataFrame:
    """Unweighted mean of each series' daily points, a missing score counting 0."""
    return (daily_series_long(scored, company)
            .groupBy("company", "series")
            .agg(_avg(F.coalesce(F.col("score"), F.lit(0.0))).alias("mean_score")))


def avg_sentiment(scored: DataFrame, company: str | None = None) -> DataFrame:
    """A4: overall and per-source mean in one pass (grouping sets).

    Rows with ``source`` NULL are the company total.
    """
    df = for_company(scored, company).withColumn("s", score_a4(F.col("sentiment")))
    return (df.groupingSets([["company"], ["company", "source"]], "company", "source")
            .agg(_avg(F.col("s")).alias("avg_sentiment")))


def interactions_30d(scored: DataFrame, as_of: _dt.date | str | None = None,
                     company: str | None = None) -> DataFrame:
    """A5: rows per day from ``as_of`` - 30 days on; days without rows are absent.

    ``as_of`` defaults to ``current_date()`` as in the service; queries pass it.
    """
    ref = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    return (for_company(scored, company)
            .filter(day() >= F.date_sub(ref, 30))
            .groupBy("company", day().alias("day"))
            .agg(F.count(F.lit(1)).alias("daily_count")))


def companies(scored: DataFrame) -> DataFrame:
    """Distinct companies."""
    return scored.select("company").distinct()


def volume_by_topic(consumed: DataFrame) -> DataFrame:
    """Rows consumed per topic and whether the topic had data.

    ``consumed`` is either decoded messages (``topic``, ``n_rows`` per
    message, so a topic whose messages were empty still appears with 0) or
    plain rows with a ``company`` column (one row each).
    """
    if "n_rows" in consumed.columns:
        per = consumed.groupBy("topic").agg(F.sum("n_rows").cast("bigint").alias("n_rows"))
    else:
        per = consumed.groupBy(F.col("company").alias("topic")).agg(F.count(F.lit(1)).alias("n_rows"))
    return per.withColumn("has_data", F.col("n_rows") > 0)


def stars_matrix(scored: DataFrame, company: str | None = None) -> DataFrame:
    """Trustpilot stars (1..5) x sentiment counts per company, zero-filled."""
    df = for_company(scored, company)
    tp = F.col("source") == "trustpilot"
    cells = [(s, x) for s in range(1, 6) for x in SENTIMENTS]
    wide = df.groupBy("company").agg(*[
        F.count(F.when(tp & (F.col("stars") == s) & (F.col("sentiment") == x), 1)).alias(f"{s}_{x}")
        for s, x in cells])
    long = wide.unpivot(["company"], [f"{s}_{x}" for s, x in cells], "cell", "n_reviews")
    return long.select(
        "company",
        F.split_part("cell", F.lit("_"), F.lit(1)).cast("int").alias("stars"),
        F.split_part("cell", F.lit("_"), F.lit(2)).alias("sentiment"),
        "n_reviews")


def avg_stars(scored: DataFrame, company: str | None = None) -> DataFrame:
    """Average stars over trustpilot rows, a missing rating counting 0."""
    return (for_company(scored, company).filter(F.col("source") == "trustpilot")
            .groupBy("company").agg(_avg(F.coalesce("stars", F.lit(0))).alias("avg_stars")))


def subreddit_matrix(scored: DataFrame, company: str | None = None) -> DataFrame:
    """Observed subreddit x sentiment counts, zero-filled over the sentiments."""
    df = for_company(scored, company).filter(F.col("source") == "reddit")
    wide = df.groupBy("company", "subreddit").agg(*[
        F.count(F.when(F.col("sentiment") == x, 1)).alias(x) for x in SENTIMENTS])
    return wide.unpivot(["company", "subreddit"], SENTIMENTS, "sentiment", "n_reviews")


def avg_vote(scored: DataFrame, company: str | None = None) -> DataFrame:
    """Average reddit vote, missing as 0."""
    return (for_company(scored, company).filter(F.col("source") == "reddit")
            .groupBy("company").agg(_avg(F.coalesce("vote", F.lit(0))).alias("avg_vote")))


def reddit_points(scored: DataFrame, company: str | None = None) -> DataFrame:
    """(vote, replies) points per sentiment, kept as rows."""
    return (for_company(scored, company).filter(F.col("source") == "reddit")
            .select("company", "id", "sentiment",
                    F.coalesce("vote", F.lit(0)).alias("score"),
                    F.coalesce("reddit_reply_count", F.lit(0)).alias("replies")))


def youtube_engagement(scored: DataFrame, company: str | None = None) -> DataFrame:
    """Mean likes / replies per sentiment (0 when none) and overall mean likes."""
    df = for_company(scored, company).filter(F.col("source") == "youtube")
    likes, replies = F.coalesce("like_count", F.lit(0)), F.coalesce("youtube_reply_count", F.lit(0))
    aggs = [F.avg(likes).alias("overall_likes")]
    for x in SENTIMENTS:
        m = F.col("sentiment") == x
        aggs += [F.avg(F.when(m, likes)).alias(f"l_{x}"), F.avg(F.when(m, replies)).alias(f"r_{x}")]
    wide = df.groupBy("company").agg(*aggs)
    long = wide.select(
        "company", "overall_likes",
        F.explode(F.array(*[F.struct(F.lit(x).alias("sentiment"), F.col(f"l_{x}").alias("l"),
                                     F.col(f"r_{x}").alias("r")) for x in SENTIMENTS])).alias("e"))
    return long.select(
        "company", F.col("e.sentiment").alias("sentiment"),
        F.round(F.coalesce(F.col("e.l"), F.lit(0.0)), SCALE).alias("avg_likes"),
        F.round(F.coalesce(F.col("e.r"), F.lit(0.0)), SCALE).alias("avg_replies"),
        F.round("overall_likes", SCALE).alias("overall_avg_likes"))


#: Companies up to which their latest ids (three, some 100 bytes) are broadcast.
BROADCAST_COMPANIES = 200_000


def last_comment(scored: DataFrame, company: str | None = None) -> DataFrame:
    """Latest comment per source, three fixed columns, NULL when none.

    One narrow aggregate gives each company its latest id of each source, without
    text, computed once. While they are few, those ids are broadcast
    and the texts are one filtered scan that moves nothing; more of them are joined by shuffle.
    """
    df = for_company(scored, company).withColumn("_src", F.lower(F.col("source")))
    latest = df.groupBy("company").agg(*[F.max_by("id", F.when(F.col("_src") == x, F.struct("date", "id"))).alias(x) for x in SOURCES])
    latest, _ = small_table(latest, BROADCAST_COMPANIES)
    ids = latest.select("company", F.explode(F.array(*[F.struct(F.lit(x).alias("_src"), F.col(x).alias("id")) for x in SOURCES])).alias("e"))
    ids = ids.select("company", "e.*").filter(F.col("id").isNotNull())
    few = df.select("company", "_src", "id", "text").join(ids, ["company", "_src", "id"]).select("company", "_src", "text")
    everyone = latest.select("company", F.lit(None).cast("string").alias("_src"), F.lit(None).cast("string").alias("text"))
    return few.unionByName(everyone).groupBy("company").agg(*[F.max(F.when(F.col("_src") == x, F.col("text"))).alias(x) for x in SOURCES])
