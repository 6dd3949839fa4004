"""Operator 9: exact duplicates through an extendible-hash index on shared files.

Native: DataFrame operations only.

* Every text is normalised (A-Z lower-cased, null = empty) and keyed by a
  64-bit hash. The index entry (key, id, digest) is narrow: no text moves.
* **Directory.** A histogram of key prefixes (at most ``2**MAX_DEPTH`` counted
  rows) is all the driver sees. Buckets that hold more than ``bucket_rows``
  entries split on their next key bit; when a bucket's local depth passes the
  global depth the directory doubles. A bucket that still overflows at
  ``MAX_DEPTH`` (one key with a third of all rows) becomes a chained bucket:
  its entries are spread over ``SALTS`` overflow pages.
* **Shared files.** Entries are written to the cluster's shared folder, range
  partitioned by (bucket, page), so that each owner task holds whole key ranges.
* **Chains.** Only keys with two or more entries need their texts. These are
  compared byte by byte by grouping on (key, text), which Spark pre-aggregates
  before the shuffle, so a hot text is one row per map task. Two texts with one
  key form a chain: its documents are told apart by their texts.

Edge cases: null text equals the empty text; an empty table gives an empty
result; rows that repeat a doc_id are entries of their own (each counts in
group_size, and each copy of the kept id is marked kept); a null doc_id never
wins over a number and is kept only in a group of null ids; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from feedlens.llm.common import ascii_lower, free_name, numbered, scratch, small, texts, written

MAX_DEPTH = 14   # directory of at most 16,384 slots
SALTS = 32       # overflow pages of a chained bucket


def directory(histogram: dict[int, int], bucket_rows: int, max_depth: int = MAX_DEPTH) -> tuple[list[int], list[int]]:
    """(slots, chained): bucket id per key prefix of the final global depth, and the buckets that overflow.

    ``histogram``: entries by prefix of ``max_depth`` bits. Starts with one
    bucket and splits overfull ones bit by bit, doubling when needed.
    """
    depth, buckets, chained = 0, [(0, 0, sum(histogram.values()))], []  # (prefix, local depth, entries)
    done: list[tuple[int, int, int]] = []
    while buckets:
        prefix, local, n = buckets.pop()
        if n <= bucket_rows:
            done.append((prefix, local, n))
        elif local == max_depth:
            chained.append(len(done))
            done.append((prefix, local, n))
        else:
            depth = max(depth, local + 1)  # directory doubling
            shift, left = max_depth - local - 1, prefix * 2
            n0 = sum(histogram.get(p, 0) for p in range(left << shift, (left + 1) << shift))
            buckets += [(left, local + 1, n0), (left + 1, local + 1, n - n0)]
    slots = [0] * (1 << depth)
    for b, (prefix, local, _) in enumerate(done):
        width = 1 << (depth - local)
        slots[prefix * width:(prefix + 1) * width] = [b] * width
    return slots, chained


def exact_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 bucket_rows: int = 100_000, key_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket, chain) for every row.

    ``key_bits``: bits of the key that are used; fewer only to test chains.
    """
    t = texts(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    keyed = t.withColumn("key", F.shiftright(F.xxhash64("norm"), 64 - key_bits) if key_bits < 64 else F.xxhash64("norm"))
    flat = F.col("key") if key_bits == 64 else F.shiftleft(F.col("key"), 64 - key_bits)
    prefix = F.shiftrightunsigned(flat, 64 - MAX_DEPTH).cast("int")

    entries = written(spark, keyed.select("doc_id", "key", prefix.alias("prefix"),
                                          F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "entries")
    histogram = {r[0]: r[1] for r in entries.groupBy("prefix").count().collect()}  # at most 2**MAX_DEPTH rows
    slots, chained = directory(histogram, bucket_rows)
    shift = MAX_DEPTH - (len(slots).bit_length() - 1)
    bucket = F.lit(slots)[F.shiftright(F.col("prefix"), shift)]
    page = F.when(F.col("bucket").isin(chained), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0) if chained else F.lit(0)
    index = (entries.withColumn("bucket", bucket).withColumn("page", page.cast("int")).drop("prefix")
             .repartitionByRange("bucket", "page", "key"))
    index = written(spark, index, "index")

    repeated = index.groupBy("key").count().where("count > 1").select("key")
    repeated = written(spark, repeated, "repeated-keys")
    candidates = keyed.join(small(repeated), "key", "left_semi")
    chains = written(spark, candidates.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"),
                                                                  F.count(F.lit(1)).alias("group_size")), "chains")
    lengths = chains.groupBy("key").agg(F.count(F.lit(1)).alias("n_chains"), F.max("keep_id").alias("keep_id"),
                                        F.max("group_size").alias("group_size"))
    single = lengths.where("n_chains = 1").select("key", "keep_id", "group_size", F.lit(0).alias("chain"))
    forked = written(spark, lengths.where("n_chains > 1").select("key"), "forked-keys")

    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
           "text_sha256", "bucket", "chain"]
    spread = F.explode(F.when(F.col("bucket").isin(chained), F.sequence(F.lit(0), F.lit(SALTS - 1)))
                       .otherwise(F.array(F.lit(0)))).alias("page") if chained else F.lit(0).alias("page")
    key_prefix = F.shiftrightunsigned(flat, 64 - MAX_DEPTH).cast("int")
    single = (single.withColumn("prefix", key_prefix).withColumn("bucket", bucket)
              .select("key", spread, "keep_id", "group_size", "chain"))
    plain = (index.join(small(single), ["key", "page"], "left")
             .join(small(forked), "key", "left_anti")
             .withColumns({"keep_id": F.coalesce("keep_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1)),
                           "chain": F.coalesce("chain", F.lit(0))}).select(*out))
    if forked.isEmpty():
        return plain
    # Keys shared by different texts: the documents find their chain by their bytes.
    numbered = (chains.join(small(forked), "key", "left_semi")
                .withColumn("chain", F.row_number().over(Window.partitionBy("key").orderBy("norm")) - 1))
    members = (keyed.join(small(forked), "key", "left_semi")
               .withColumn("page", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))
    copies = numbered.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = (members.join(copies, ["key", "norm", "page"])
            .withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
            .withColumn("prefix", key_prefix).withColumn("bucket", bucket).select(*out))
    return plain.unionByName(told)


def keep_last(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less the duplicates: one row of each group stays, one with the largest id.

    Decided by row: rows with one id, or none, are told apart by their texts.
    """
    rows, key = numbered(spark, docs, id_col)
    # Row keys without an id lie below all others: they never win over a number.
    flipped = -1 - F.col(key)
    own = rows.withColumn(key, F.when(F.col(id_col).isNull(), flipped).otherwise(F.col(key)))
    name = free_name(rows, "__gone")
    with scratch(spark):
        gone = exact_groups(spark, own, key, text_col).where("NOT kept").select(F.col("doc_id").alias(key))
        gone = written(spark, gone.select(F.when(F.col(key) < 0, flipped).otherwise(F.col(key)).alias(name)), "gone", stays=True)
    return rows.join(small(gone), rows[key] == gone[name], "left_anti").select(*docs.columns)
