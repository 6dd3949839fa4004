"""Training-set building, sampling and caps.

Sampling is exact and seedless: rows are ordered by ``md5(id)`` inside their
stratum, so the same input gives the same split in Spark and in any SQL
engine, on any cluster size.

Scale: a stratum (one company x sentiment) may hold a third of all rows, and
the cut (20 % for a split, a class count for balancing) is large, so a window
over the stratum would sort that third in one task. ``cuts`` instead finds the row at
the wanted rank: a histogram over hash-prefix buckets says in which bucket it lies,
and only that bucket, 1/4096 of a stratum, is ranked. Every other row is then decided
where it is read, by comparing its (md5, id) with the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlens.operators.parallel import replicate, small_table
from feedlens.session import checkpoint_dir

BUCKET_HEX = 3  # 4,096 hash-prefix buckets per stratum


def md5_key(id_col: str = "id") -> Column:
    return F.md5(F.col(id_col).cast("string"))


#: Strata up to which their cuts (some 100 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_STRATA = 200_000


def cuts(df: DataFrame, keys: list[str], ranks, order: Column | None = None, id_col: str = "id", bucket_hex: int = BUCKET_HEX) -> DataFrame:
    """For each stratum the rows at given ranks: (keys.., n, name.., at_name..), ``at_name`` = (order, id) of the row of that rank.

    ``ranks`` adds to a table with the strata's sizes (keys.., n; several rows a stratum) a column for each
    rank wanted; what it adds with a leading underscore is kept as it is. A rank below 1 gives NULL, one beyond
    the stratum its last row. A row is among the first k when its (order, id) is not above the cut, so no rows are
    shuffled but narrow histograms and the buckets that hold a cut:

    1. rows by (stratum, hash-prefix bucket), one partial aggregate; the bucket in which each wanted rank falls,
       from a running sum over a stratum's buckets;
    2. the rank inside those buckets alone, 1 / 4096 of a stratum each, found by a broadcast of the (few) buckets.
    """
    o = md5_key(id_col) if order is None else order
    d = df.select(*keys, id_col, o.alias("_o")).withColumn("_b", F.substring("_o", 1, bucket_hex))
    stratum = Window.partitionBy(*keys)
    hist = (d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("n", F.sum("_n").over(stratum))
            .withColumn("_to", F.sum("_n").over(stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))))
    known = hist.columns
    sized = ranks(hist)
    kept = [c for c in sized.columns if c not in known]
    names = [c for c in kept if not c.startswith("_")]
    # A row for each rank, in its bucket; one without a name, in the first bucket, stands for the stratum.
    wanted = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(1).cast("bigint").alias("rank")),
                     *[F.struct(F.lit(n).alias("name"), F.when(F.col(n).isNotNull(), F.least(F.col(n), F.col("n"))).cast("bigint").alias("rank")) for n in names])
    at = (sized.withColumn("_w", F.explode(wanted)).filter((F.col("_w.rank") <= F.col("_to")) & (F.col("_w.rank") > F.col("_to") - F.col("_n")))
          .select(*keys, "n", *kept, "_b", F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_to") + F.col("_n")).alias("_need")))
    at, few = small_table(at, BROADCAST_STRATA * (1 + len(names)))
    strata = at.filter("_name IS NULL").select(*keys, "n", *kept)
    inside = Window.partitionBy(*keys, "_name").orderBy("_o", id_col)
    found = (d.join(at.filter("_name IS NOT NULL").select(*keys, "_b", "_name", "_need"), [*keys, "_b"])
             .withColumn("_r", F.row_number().over(inside)).filter(F.col("_r") == F.col("_need"))
             .groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.struct("_o", F.col(id_col).alias("_id")))).alias(f"at_{n}") for n in names]))
    out = strata.join(found, keys, "left")
    return F.broadcast(out) if few else out  # a row for each stratum that was just counted


def with_cuts(df: DataFrame, keys: list[str], table: DataFrame, order: Column | None = None, id_col: str = "id") -> DataFrame:
    """``df`` with the columns of ``table`` (from :func:`cuts`) and its own (order, id) as ``_at``; rows don't move while strata are few."""
    o = md5_key(id_col) if order is None else order
    return df.join(table, keys).withColumn("_at", F.struct(o.alias("_o"), F.col(id_col).alias("_id")))


def until(name: str) -> Column:
    """Whether a row is among the first ``name`` of its stratum."""
    return F.coalesce(F.col("_at") <= F.col(f"at_{name}"), F.lit(False))


def drop_unknown(df: DataFrame) -> DataFrame:
    """Drop rows whose label is unknown."""
    return df.filter(F.col("sentiment") != "unknown")


def stratified_split(df: DataFrame, test_size: float = 0.2,
                     strata: tuple[str, ...] = ("company", "sentiment")) -> DataFrame:
    """Per stratum the first ceil(test_size * n) rows by md5(id) are test, the rest train."""
    table = cuts(df, list(strata), lambda t: t.withColumn("test", F.ceil(F.col("n") * F.lit(test_size))))
    out = with_cuts(df, list(strata), table)
    return out.select(*df.columns, F.when(until("test"), "test").otherwise("train").alias("split"))


def balance(train: DataFrame, neutral: str = "neutral") -> DataFrame:
    """Per company, resample neutral rows to the largest non-neutral class.

    Down-sampling keeps the first ``target`` neutral rows by md5(id). When
    neutral is short, every neutral row is repeated ``target // n`` times and
    the first ``target % n`` rows once more (sampling with replacement made
    exact). Non-neutral rows pass unchanged with ``copy`` = 1. A company
    without neutral rows keeps its other rows; a company without non-neutral
    rows keeps its neutral rows as they are.

    Targets and cuts come from the histogram of :func:`cuts`; rows are decided where they are
    read, and chunked replication expands the copies.
    """
    return _balanced(train, 0.0, neutral)


def split_balanced(df: DataFrame, test_size: float = 0.2, neutral: str = "neutral") -> DataFrame:
    """U6 then U7 in one go: the balanced training part of a stratified split.

    The same rows as ``balance`` over the train rows of ``stratified_split``: both are cuts by
    rank in the same order, a train row's rank being its rank less the test cut.
    """
    return _balanced(df, test_size, neutral)


def _balanced(df: DataFrame, test_size: float, neutral: str) -> DataFrame:
    keys = ["company", "sentiment"]
    company = Window.partitionBy("company")  # rows of the histogram
    is_neu = F.col("sentiment") == neutral

    def ranks(strata: DataFrame) -> DataFrame:
        t = strata.withColumn("test", F.ceil(F.col("n") * F.lit(test_size))).withColumn("_train", F.nullif(F.col("n") - F.col("test"), F.lit(0)))
        t = (t.withColumn("_target", F.max(F.when(~is_neu, F.col("_train"))).over(company))
             .withColumn("_cur", F.max(F.when(is_neu, F.col("_train"))).over(company)))
        extra = F.when(F.col("_cur") < F.col("_target"), F.col("_target") % F.col("_cur")).otherwise(F.col("_target"))
        return t.withColumn("more", F.when(is_neu, F.col("test") + F.coalesce(extra, F.lit(0))))

    d = with_cuts(df, keys, cuts(df, keys, ranks)).filter(~until("test"))
    once = F.when(until("more"), 1).otherwise(0)
    copies = (F.when(~is_neu | F.col("_target").isNull(), 1)
              .when(F.col("_cur") < F.col("_target"), F.floor(F.col("_target") / F.col("_cur")) + once)
              .otherwise(once)).cast("bigint")
    d = d.select(*df.columns, copies.alias("_copies")).filter(F.col("_copies") > 0)
    return replicate(d, "_copies", "copy").drop("_copies")


def quota_sample(df: DataFrame, quota: int = 80, key: str = "stars") -> DataFrame:
    """The ``quota`` most recent rows per (company, stars); 3 stars get twice the quota.

    The window limit is the literal maximum (2 x quota) so Spark plans a
    partial WindowGroupLimit before the shuffle; the per-group quota is a
    filter on top.
    """
    w = Window.partitionBy("company", key).orderBy(F.col("date").desc(), F.col("id").desc())
    ranked = (df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 2 * quota)
            .withColumn("rank", F.col("rank").cast("bigint")))
    limit = F.when(F.col(key) == 3, 2 * quota).otherwise(quota)
    return ranked.filter(F.col("rank") <= limit)


def train_set(tp: DataFrame, yt: DataFrame, tp_simple: bool = True) -> DataFrame:
    """U1 + P13 + P14: labelled trustpilot and youtube rows, tagged by source, encoded 0/1/2."""
    if tp_simple:
        tp = tp.filter(~F.col("stars").isin(2, 4) | F.col("stars").isNull())
    both = (tp.select("id", "text", "sentiment", F.lit("trustpilot").alias("source"))
            .unionByName(yt.select("id", "text", "sentiment", F.lit("youtube").alias("source"))))
    code = F.create_map(F.lit("negative"), F.lit(0), F.lit("neutral"), F.lit(1), F.lit("positive"), F.lit(2))
    return both.withColumn("sentiment_encoded", code[F.col("sentiment")])


def cap_per_item(df: DataFrame, item: str, cap: int, ascending: bool = True) -> DataFrame:
    """At most ``cap`` rows per item in arrival order (oldest first)."""
    o = [F.col("date").asc(), F.col("id").asc()] if ascending else [F.col("date").desc(), F.col("id").desc()]
    w = Window.partitionBy("company", item).orderBy(*o)
    return (df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)
            .withColumn("rank", F.col("rank").cast("bigint")))


def newest_unseen(posts: DataFrame, seen: DataFrame, n: int = 10) -> DataFrame:
    """W8 (+ J3): anti join the already-seen ids, then the newest ``n`` per company."""
    fresh = posts.join(seen.select("id"), "id", "left_anti")
    w = Window.partitionBy("company").orderBy(F.col("date").desc(), F.col("id").desc())
    return (fresh.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("bigint")))


def unseen_items(items: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Items not seen before (left anti join on the item key)."""
    return items.join(seen.select(*keys).distinct(), keys, "left_anti")


PIECE = "_piece"


def in_pieces(df: DataFrame, keys: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """``df`` cut by ranges of (keys, order) into pieces of like size, numbered in that order (column ``_piece``).

    The bounds are approximate quantiles that Spark samples, so neither a key nor a day
    within it decides how large a piece is; only rows equal in keys and order stay together. The bounds
    of another run may differ, so the rows are checkpointed with their numbers.
    """
    checkpoint_dir(df.sparkSession)
    by = [*keys, *order]
    ranged = df.repartitionByRange(pieces, *by) if pieces else df.repartitionByRange(*by)
    return ranged.withColumn(PIECE, F.spark_partition_id()).checkpoint()


def prior_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "prior_total",
                pieces: int | None = None) -> DataFrame:
    """Running sum of ``value`` over rows strictly before each row (in ``order``) within ``keys``: a parallel prefix sum.

    Three levels: rows are cut into range pieces, each (key, piece) has a sum, the sums of a
    key are summed up in piece order (one row a piece, however many rows a key has), and rows are
    ordered only within their own (key, piece). ``order`` should be total; NULL keys are a key.
    """
    d = in_pieces(df, keys, order, pieces)
    sums = d.groupBy(*keys, PIECE).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(PIECE).alias("_p"),
                          F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col(PIECE) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0))).join(offsets, same)
    return d.withColumn(out, (F.col("_before") + F.col("_inner")).cast("bigint")).select(*df.columns, out)


def company_budget(items: DataFrame, budget: int) -> DataFrame:
    """Walk items in order, keep each item whose earlier total of comments is below budget.

    ``items`` has one row per (company, item) with ``n_comments`` and an
    ``item_order`` timestamp; a parallel prefix sum replaces the crawler's loop, so neither a company
    nor one of its days is ordered in one task.
    """
    return prior_total(items, ["company"], ["item_order", "item"], "n_comments").filter(F.col("prior_total") < budget)


def class_counts(df: DataFrame) -> DataFrame:
    """Rows per (company, sentiment)."""
    return df.groupBy("company", "sentiment").agg(F.count(F.lit(1)).alias("n_rows"))
