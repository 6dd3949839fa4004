"""The star-shaped warehouse (the document store, S4, is in sources.files).

One scored frame fans out to a ``predictions`` fact table and three
per-source satellite tables. The writer persists the scored frame once so the
(possibly expensive) scoring is not recomputed per sink, writes each table in
one job, and unpersists. Tables are Parquet by default (partitioned by
company for the fact table, so the per-company dashboard queries prune
partitions), or JDBC when a URL is given.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the warehouse's tables.
PREDICTIONS = ["id", "source", "date", "company", "sentiment"]
SATELLITES = {
    "trustpilot": ["id", "stars", "location"],
    "youtube": ["id", "videoid", "like_count", "youtube_reply_count",
                "negative_probability", "neutral_probability", "positive_probability"],
    "reddit": ["id", "subreddit", "vote", "reddit_reply_count",
               "negative_probability", "neutral_probability", "positive_probability"],
}
PROBS = ["negative_probability", "neutral_probability", "positive_probability"]


def fan_out(scored: DataFrame) -> dict[str, DataFrame]:
    """S5 projections (P4 routes by source); probabilities stored as FLOAT."""
    out = {"predictions": scored.select(*PREDICTIONS)}
    for src, cols in SATELLITES.items():
        sel = [F.col(c).cast("float").alias(c) if c in PROBS else F.col(c) for c in cols]
        out[src] = scored.filter(F.col("source") == src).select(*sel)
    return out


def write_warehouse(scored: DataFrame, path: str | None = None, jdbc_url: str | None = None,
                    jdbc_props: dict | None = None, mode: str = "append") -> dict[str, str]:
    """Write the fact and satellite tables from one persisted frame."""
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        written = {}
        for name, df in fan_out(scored).items():
            if jdbc_url:
                df.write.jdbc(jdbc_url, name, mode=mode, properties=jdbc_props or {})
                written[name] = f"{jdbc_url}#{name}"
            else:
                w = df.write.mode(mode)
                if name == "predictions":
                    w = w.partitionBy("company")
                w.parquet(f"{path}/{name}")
                written[name] = f"{path}/{name}"
        return written
    finally:
        scored.unpersist()


#: Buckets of a co-located warehouse: a task of a detail join reads one of them from each table.
BUCKETS = 8


def store_warehouse(scored: DataFrame, path: str, prefix: str, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """S5 as co-located tables ``prefix_<name>`` at ``path``: all four bucketed and sorted by id, predictions by company too.

    Rows are dealt to the buckets once, by the hash that the tables' buckets have, so a task writes one bucket
    and a bucket is one file (for each company of the fact table). Joins and anti joins on id
    then need no exchange; a company filter still prunes. ``buckets`` should grow with the data (about a
    gigabyte each). The tables are in the session's catalog: a shared metastore makes them last.
    """
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for name, df in fan_out(scored).items():
            w = df.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").mode("overwrite").option("path", f"{path}/{name}")
            if name == "predictions":
                w = w.partitionBy("company")
            w.saveAsTable(f"{prefix}_{name}")
    finally:
        scored.unpersist()
    return stored_warehouse(scored.sparkSession, prefix)


def stored_warehouse(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    """The tables of :func:`store_warehouse`."""
    return {n: spark.table(f"{prefix}_{n}") for n in ["predictions", *SATELLITES]}


def read_warehouse(spark: SparkSession, path: str | None = None, jdbc_url: str | None = None,
                   jdbc_props: dict | None = None) -> dict[str, DataFrame]:
    """The four tables back as DataFrames; over JDBC in 17 parts by the first digit of the hexadecimal id."""
    names = ["predictions", *SATELLITES]
    if jdbc_url:
        digits = "0123456789abcdef"
        parts = [f"substring(id, 1, 1) = '{x}'" for x in digits]
        parts.append("id IS NULL OR substring(id, 1, 1) NOT IN (" + ", ".join(f"'{x}'" for x in digits) + ")")
        return {n: spark.read.jdbc(jdbc_url, n, predicates=parts, properties=jdbc_props or {}) for n in names}
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def detail(tables: dict[str, DataFrame], source: str, company: str | None = None) -> DataFrame:
    """A satellite table joined with predictions on id (company via predictions)."""
    pred = tables["predictions"]
    if company is not None:
        pred = pred.filter(F.col("company") == F.lit(company))
    return tables[source].join(pred.select("id", "company", "date", "sentiment"), "id")


def canonical_nulls(rows: DataFrame) -> DataFrame:
    """NULLs in the columns of canonical reviews that must have a value, as counts."""
    return rows.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in ("source", "text", "company")])


def pk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Ids that occur more than once, per table."""
    parts = [df.groupBy("id").count().filter(F.col("count") > 1)
             .select(F.lit(name).alias("table_name"), "id", F.col("count").alias("n_rows"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Satellite ids missing from predictions (anti join)."""
    pred = tables["predictions"].select("id")
    parts = [tables[s].select("id").join(pred, "id", "left_anti").select(F.lit(s).alias("table_name"), "id")
             for s in SATELLITES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """NOT NULL columns (predictions.id, predictions.source) that hold NULL, as counts."""
    pred = tables["predictions"]
    return pred.agg(
        F.count(F.when(F.col("id").isNull(), 1)).alias("null_id"),
        F.count(F.when(F.col("source").isNull(), 1)).alias("null_source"),
        F.count(F.when(F.col("company").isNull(), 1)).alias("null_company"),
    )
