"""Nearest reviews per topic and assembled answers.

Exact k-nearest search of every review vector against the topic vectors. The
topic table (one vector per topic of the dashboard) enters the projection as a
scalar subquery: it is computed once, when the query runs, and every review row
computes its distances to all topics in one expression: no join, no cross join,
no shuffle before the top-k, and no job while the query is built. Top-k per
(company, sentiment, source, topic) is a row_number limit that Spark plans as a
partial WindowGroupLimit, so a hot company only ships k rows per map task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlens.functions.score import SENTIMENTS, SOURCES
from feedlens.functions.summary import summary
from feedlens.functions.text import clean_text, first_chunk, tokens
from feedlens.operators.parallel import spread

K = 3
DIST_SCALE = 6
# Retrieval topics and the empty-answer text.
TOPICS = ["Customer service", "Product quality", "Price", "General"]
NO_REVIEWS = "No reviews found"
GROUP = ["company", "sentiment", "source"]


def reviews_in_range(df: DataFrame, sentiment: str, source: str, date_from: str | None = None,
                     date_to: str | None = None, inclusive_day: bool = False) -> DataFrame:
    """Filter by sentiment and source and an optional date range.

    Bounds are dates taken at midnight, so by default the last day is cut
    after 00:00 (the reference rule); ``inclusive_day`` keeps the whole day.
    """
    out = df.filter((F.col("sentiment") == sentiment.lower()) & (F.col("source") == source))
    if date_from:
        out = out.filter(F.col("date") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        hi = F.lit(date_to).cast("timestamp_ntz")
        out = out.filter(F.col("date") < hi + F.expr("INTERVAL 1 DAY") if inclusive_day else F.col("date") <= hi)
    return out


def chunks(df: DataFrame, size: int = 100) -> DataFrame:
    """The first chunk of each review's text; empty texts yield no row.

    The whole text is split and scanned, so the work is spread over the
    cluster first when the session asks for it.
    """
    df = spread(df)
    return df.withColumn("chunk", first_chunk(F.col("text"), size)).filter(F.col("chunk").isNotNull())


def centroids(vectors: DataFrame, key: str = "label", vec: str = "embedding") -> DataFrame:
    """Topic vectors as the per-key mean of ``vec`` (double precision)."""
    e = vectors.select(key, F.posexplode(vec).alias("pos", "x"))
    per = e.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select(
        F.col(key).alias("topic"), F.transform("s", lambda x: x["m"]).alias("vec"))


def _sq_dist(v: Column, t: Column) -> Column:
    return F.aggregate(F.zip_with(v, t, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
                       F.lit(0.0), lambda acc, x: acc + x)


def nearest(items: DataFrame, topics: DataFrame, k: int = K,
            vec: str = "embedding", group: list[str] = GROUP, id_col: str = "id") -> DataFrame:
    """Exact squared-L2 top-k items per (group, topic); ``topics``: (topic, vec)."""
    all_topics = topics.agg(F.sort_array(F.collect_list(F.struct("topic", "vec")))).scalar()
    items = items.select(*group, id_col, vec, all_topics.alias("_topics"))
    d = F.transform("_topics", lambda t: F.struct(t["topic"].alias("topic"), _sq_dist(F.col(vec), t["vec"]).alias("dist")))
    x = items.select(*group, id_col, F.explode(d).alias("d")).select(
        *group, id_col, F.col("d.topic").alias("topic"), F.col("d.dist").alias("dist"))
    w = Window.partitionBy(*group, "topic").orderBy("dist", id_col)
    r = (x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
         .withColumn("rank", F.col("rank").cast("bigint")))
    return r.withColumn("dist", F.round("dist", DIST_SCALE))


def topic_context(hits: DataFrame, texts: DataFrame, id_col: str = "id", text_col: str = "chunk") -> DataFrame:
    """The retrieved texts of each (group, topic) joined by LF in rank order (k rows per group)."""
    j = hits.join(texts.select(id_col, text_col), id_col)
    return (j.groupBy(*GROUP, "topic")
            .agg(F.array_sort(F.collect_list(F.struct("rank", text_col))).alias("_s"))
            .select(*GROUP, "topic", F.array_join(F.transform("_s", lambda x: x[text_col]), "\n")
                    .alias("context")))


def answers(companies: DataFrame, contexts: DataFrame, topics: DataFrame, summarize: Callable[[Column], Column] = summary) -> DataFrame:
    """An answer for every company x sentiment x source x topic.

    The domain is generated per company with ``explode`` of arrays, the topics'
    one a scalar subquery (no join of domains); missing contexts read "No reviews found".
    ``summarize`` maps a context column to a summary column; the default takes the most
    central sentences (:func:`feedlens.functions.summary.summary`).
    """
    dom = F.array(*[F.struct(F.lit(s).alias("sentiment"), F.lit(src).alias("source")) for s in SENTIMENTS for src in SOURCES])
    names = topics.agg(F.collect_set("topic")).scalar()
    grid = companies.select("company", names.alias("_topics"), F.explode(dom).alias("d")).select(
        "company", "d.sentiment", "d.source", F.explode("_topics").alias("topic"))
    j = grid.join(contexts, [*GROUP, "topic"], "left")
    return j.select(*GROUP, "topic", F.coalesce(summarize(F.col("context")), F.lit(NO_REVIEWS)).alias("answer"))


def nest_answers(flat: DataFrame) -> DataFrame:
    """Answer document: company -> map<sentiment, map<source, map<topic, answer>>>."""
    t = flat.groupBy("company", "sentiment", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("topic", "answer"))).alias("m"))
    s = t.groupBy("company", "sentiment").agg(F.map_from_entries(F.collect_list(F.struct("source", "m"))).alias("m"))
    return s.groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("sentiment", "m"))).alias("answers"))


def flatten_answers(nested: DataFrame) -> DataFrame:
    a = nested.select("company", F.explode("answers").alias("sentiment", "m1"))
    b = a.select("company", "sentiment", F.explode("m1").alias("source", "m2"))
    return b.select(*GROUP, F.explode("m2").alias("topic", "answer"))


def answers_upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed upsert by company (new documents replace old ones)."""
    return new.unionByName(store.join(new.select("company").distinct(), "company", "left_anti"))


def answers_read(store: DataFrame, company: str) -> DataFrame:
    """S15 read: one company's answer document."""
    return store.filter(F.col("company") == F.lit(company))


#: Dimensions of a text vector; weights of words are whole numbers of 1 / IDF_UNIT.
DIM, IDF_UNIT = 64, 10_000


def _text_words(text_col: str) -> Column:
    return F.filter(tokens(clean_text(F.col(text_col))), lambda w: w != "")


def word_weights(corpus: DataFrame, text_col: str = "chunk") -> DataFrame:
    """(word, weight): inverse document frequencies, ``1 + ln((1 + n) / (1 + df))``, of a corpus of texts; one row without word for unseen ones."""
    rows = corpus.select(_text_words(text_col).alias("w"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    df = rows.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    df = df.withColumn("n", n.scalar())
    df = df.unionByName(n.select(F.lit(None).cast("string").alias("word"), F.lit(0).cast("bigint").alias("df"), "n"))
    idf = 1 + F.log((1 + F.col("n")).cast("double") / (1 + F.col("df")))
    return df.select("word", F.round(idf * float(IDF_UNIT)).cast("bigint").alias("weight"))


def _place(word: Column) -> tuple[Column, Column]:
    """(dimension, sign) of a word from its md5: the first 8 hexadecimal digits, and whether the next is below 8."""
    digits = F.md5(word)
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint") % DIM, F.when(F.substring(digits, 9, 1) < "8", 1).otherwise(-1)


def embed_text(df: DataFrame, weights: DataFrame, text_col: str = "chunk", id_col: str = "id", out: str = "embedding") -> DataFrame:
    """T5: signed feature hashing of the cleaned tokens, weighted by ``weights``, of length 1.

    Each token adds its weight, with its sign, to one of ``DIM`` dimensions; the signs make
    collisions cancel on average. Sums are whole numbers, so the vector does not depend on
    any order. Words are counted by text before they meet the weights (joined by word; Spark
    broadcasts a small table of weights), and a text's sums are one row a text and dimension: no texts
    are shuffled but by their ids. A text without tokens has the zero vector.
    """
    place, sign = _place(F.col("word"))
    unseen = weights.filter(F.col("word").isNull()).select("weight").scalar()
    used = df.select(id_col, F.explode(_text_words(text_col)).alias("word")).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    known = used.join(weights.filter(F.col("word").isNotNull()), "word", "left").withColumn("weight", F.coalesce("weight", unseen))
    sums = known.groupBy(id_col, place.alias("dim")).agg(F.sum(sign * F.col("n") * F.col("weight")).alias("v"))
    vec = sums.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("_v"))  # at most DIM entries
    flat = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.coalesce(F.try_element_at("_v", i.cast("bigint")), F.lit(0).cast("bigint")))
    squares = F.sqrt(F.aggregate("_flat", F.lit(0).cast("bigint"), lambda t, x: t + x * x).cast("double"))
    j = df.join(vec, id_col, "left").withColumn("_flat", F.when(F.col("_v").isNotNull(), flat).otherwise(F.array_repeat(F.lit(0).cast("bigint"), DIM)))
    return (j.withColumn("_len", squares).withColumn(out, F.transform("_flat", lambda x: F.coalesce(x / F.nullif(F.col("_len"), F.lit(0.0)), F.lit(0.0))))
            .drop("_v", "_flat", "_len"))
