"""Spreading CPU-heavy per-row work over the cluster.

A scan yields one task per file split; a few large unsplittable files (one
Parquet row group each) would run text cleaning and n-gram generation in a
handful of tasks. ``spread`` adds a round-robin exchange when, and only when,
the session asks for it (``spark.feedlens.spread.partitions``); it looks at no sizes
and runs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.session import checkpoint_dir

#: Spark's setting by which a query's shuffle files go when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned inside drop their shuffle files when they end: for writes of what nothing reads again from its shuffle."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def spread(df: DataFrame) -> DataFrame:
    target = int(df.sparkSession.conf.get("spark.feedlens.spread.partitions", "0") or 0)
    return df.repartition(target) if target > 0 else df


def replicate(df: DataFrame, times: str, out: str = "copy", chunk: int = 100_000) -> DataFrame:
    """Repeat each row ``times`` times (``out`` = 1..times) without one task doing a huge explode.

    Copy numbers are cut into chunks of ``chunk``; the chunk rows are spread
    over the cluster first and expanded locally.
    """
    from pyspark.sql import functions as F

    n = F.col(times).cast("bigint")
    df = df.filter(n > 0)  # zero copies: no row (sequence(0, -1) would count down)
    c = df.withColumn("_rp_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / chunk).cast("bigint") - 1)))
    c = c.repartition(*[F.col(x) for x in df.columns[:1]], "_rp_c")
    lo = F.col("_rp_c") * chunk + 1
    hi = F.least(n, (F.col("_rp_c") + 1) * chunk)
    return (c.withColumn("_rp_k", F.explode(F.sequence(lo, hi)))
            .withColumn(out, F.col("_rp_k").cast("int")).drop("_rp_c", "_rp_k"))


def small_table(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """A table of a row for each company, stratum or the like, computed now and once, and whether it is small.

    Up to ``most`` rows are fetched by one bounded job and marked for broadcast; a larger
    table is checkpointed in the shared folder, and joins with it shuffle.
    """
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows <= most:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), True
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(), False
