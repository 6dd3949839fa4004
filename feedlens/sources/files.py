"""File sources and sinks, keyed documents, generator, lookups.

Writes go under the session's shared checkpoint folder (``spark.checkpoint.dir``)
unless a path is given, never to a machine-local temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_json(df: DataFrame, path: str, mode: str = "append") -> str:
    """JSON dataset sink (one JSON record per line, appendable)."""
    df.write.mode(mode).json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              array_of_records: bool = False) -> DataFrame:
    """JSON dataset source; ``array_of_records`` reads files holding one JSON array each."""
    r = spark.read.option("multiLine", array_of_records)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def write_json_arrays(df: DataFrame, path: str, rows_per_file: int = 10_000) -> str:
    """Array-of-records JSON files (the dataset shape the training reader expects).

    Each partition's rows are numbered and cut into runs of ``rows_per_file``, one
    JSON array per run: no file holds more records, equal rows or not, and nothing
    is counted first.
    """
    b = F.floor(F.monotonically_increasing_id() / rows_per_file)
    arrays = (df.withColumn("_b", b).groupBy("_b")
              .agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")))
    arrays.select("value").write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)  # an array is a file
    return path


KEYED_SCHEMA = "map<string, array<struct<text: string, date: string, yt_videoid: string, " \
               "topic: string, sentiment: string>>>"


def keyed_documents(rows: DataFrame, document: Column | None = None) -> DataFrame:
    """{company: [comment, ..], ..} documents built from rows.

    Rows with the same ``document`` are one document with a list for each of their companies; by default
    each row is one.
    """
    c = F.struct(F.col("text"), F.col("date").cast("string").alias("date"),
                 F.col("videoid").alias("yt_videoid"), F.col("topic"), F.col("sentiment"))
    if document is None:
        return rows.select(F.to_json(F.create_map(F.col("company"), F.array(c))).alias("doc"))
    lists = rows.select(document.alias("_d"), "company", c.alias("c")).groupBy("_d", "company").agg(F.collect_list("c").alias("items"))
    return lists.groupBy("_d").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("company", "items")))).alias("doc")).select("doc")


def flatten_keyed(docs: DataFrame, col: str = "doc") -> DataFrame:
    """Flatten keyed JSON documents into rows (explode the map, then the array)."""
    m = docs.select(F.explode(F.from_json(col, KEYED_SCHEMA)).alias("company", "items"))
    return m.select("company", F.explode("items").alias("c")).select("company", "c.*")


def write_doc_store(scored: DataFrame, path: str, mode: str = "append") -> str:
    """Per-company collections as one partitioned write (no per-company loop, no counts)."""
    (scored.select("company", "source", "date", "text", "sentiment")
     .write.mode(mode).partitionBy("company").parquet(path))
    return path


def read_doc_store(spark: SparkSession, path: str, company: str | None = None) -> DataFrame:
    """Read collections back; a company filter prunes to that partition folder."""
    df = spark.read.parquet(path)
    return df if company is None else df.filter(F.col("company") == F.lit(company))


# Longitude and latitude by location: country names as reviewers give them, and for the test tables,
# whose reviews have a language instead, a country of each language.
LOCATIONS = [
    ("USA", -100.0, 40.0), ("Germany", 10.0, 51.0), ("France", 2.0, 46.0), ("UK", -3.0, 55.0),
    ("de", 10.0, 51.0), ("fr", 2.0, 46.0), ("en", -3.0, 55.0), ("es", -4.0, 40.0),
]


def geo_points(spark: SparkSession, tp: DataFrame) -> DataFrame:
    """Trustpilot rows with coordinates; unmatched locations are dropped (inner join).

    The lookup is a literal table of a few rows, so broadcasting it is safe at any scale.
    """
    lut = spark.createDataFrame(LOCATIONS, "location string, lon double, lat double")
    return tp.join(F.broadcast(lut), "location").select("id", "company", "sentiment", "location", "lon", "lat")


# Word stock of the synthetic text generator.
SYNTH_WORDS = ["service", "price", "quality", "support", "delivery", "app", "update", "account",
               "great", "slow", "fast", "broken", "love", "hate", "refund", "team"]


def synth_reviews(counts: DataFrame, seed: int = 42, chunk: int = 100_000) -> DataFrame:
    """Synthetic reviews, ``n`` per company from ``counts(company, n)``.

    Each row's fields are hashes of (company, row number, seed), so the output
    is identical on any partitioning. Rows are generated in two steps: a
    company's count is cut into chunks of ``chunk`` row numbers, the chunks are
    spread over the cluster, and each chunk expands locally, so a company
    with a third of all rows still fans out over many tasks.
    """
    n = F.col("n").cast("bigint")
    chunks = counts.filter(n > 0).select("company", n.alias("n"), F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.ceil(n / chunk).cast("bigint") - 1)).alias("c"))
    chunks = chunks.repartition("company", "c")
    lo = F.col("c") * chunk + 1
    hi = F.least(F.col("n"), (F.col("c") + 1) * chunk)
    rows = chunks.select("company", F.explode(F.sequence(lo, hi)).alias("k"))

    def h(tag: str):
        return F.abs(F.xxhash64(F.col("company"), F.col("k"), F.lit(seed), F.lit(tag)))

    src = F.element_at(F.array(F.lit("trustpilot"), F.lit("youtube"), F.lit("reddit")),
                       (h("source") % 3 + 1).cast("int"))
    words = F.array(*[F.lit(w) for w in SYNTH_WORDS])
    text = F.array_join(F.transform(F.sequence(F.lit(1), (h("len") % 12 + 4).cast("int")),
                                    lambda i: F.element_at(words, (F.abs(F.xxhash64(F.col("k"), i, F.lit(seed)))
                                                                   % len(SYNTH_WORDS) + 1).cast("int"))), " ")
    date = F.date_format(F.date_sub(F.lit("2025-01-01").cast("date"), (h("date") % 365).cast("int")), "yyyy-MM-dd")
    return rows.select(
        src.alias("source"), date.alias("date"), "company", text.alias("text"),
        F.when(src == "trustpilot", (h("stars") % 5 + 1).cast("int")).alias("stars"),
        F.when(src == "trustpilot", F.concat(F.lit("city_"), (h("city") % 50).cast("string"))).alias("location"),
        F.when(src == "youtube", F.sha2(F.concat_ws("-", "company", F.col("k").cast("string")), 224))
        .alias("videoid"),
        F.when(src == "youtube", (h("likes") % 5 + 1).cast("int")).alias("like_count"),
        F.when(src == "youtube", (h("yrep") % 10000 + 1).cast("int")).alias("youtube_reply_count"),
        F.when(src == "reddit", F.lit("random")).alias("subreddit"),
        F.when(src == "reddit", (h("vote") % 100 + 1).cast("int")).alias("vote"),
        F.when(src == "reddit", (h("rrep") % 1000 + 1).cast("int")).alias("reddit_reply_count"))
