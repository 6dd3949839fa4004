"""N-gram counts per company.

Texts are cleaned by Spark; a task counts them in batches of some ``CHUNK`` bytes with numpy
(tokens as numbers, a gram as its prefix's number and its last token), so it holds one batch, however
large its split. A batch leaves one row per company and bucket (a hash of a gram's first two words) with its
grams, sorted, and their counts. These rows, far fewer and smaller than rows of single grams,
cross the network once, by company and bucket, and are summed a few buckets at a time. A company holding a
third of all rows spreads over every reducer, and so does a frequent first word. Top-k per (company, n)
runs as a window with a row_number limit, which Spark plans as a partial ``WindowGroupLimit`` before its shuffle:
only k rows per group and map task cross the network.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlens.functions.text import STOP_WORDS, clean_text, not_blank, well_formed
from feedlens.operators.parallel import spread

NAMES = {1: "word", 2: "bigram", 3: "trigram"}
#: Bytes of cleaned text that a task counts at once.
CHUNK = 8_000_000
#: Bytes of a word that are hashed for all words at once.
HASHED = 32
#: Buckets of a company's grams, and parts of those that begin with the same word, by their second word.
BUCKETS, PARTS = 1024, 16
GROUPED = "company string, bucket int, grams string, counts array<int>"
STORED = "company string, bucket int, grams string, counts array<bigint>, part int"


def ngram_counts(docs: DataFrame, max_n: int = 3, stop_words: list[str] = STOP_WORDS,
                 text_col: str = "text", ns: tuple[int, ...] | None = None, most: int | None = None, parts: int | None = None) -> DataFrame:
    """T2 + A8/A9/A10: (company, n, gram, count) for every gram of every text.

    Unigrams drop empty tokens and stop words; bigrams and trigrams keep both
    (the reference rule). ``ns`` restricts generation to some n (a filter on
    ``n`` cannot be pushed below the counting, so callers needing one n say so).
    ``most``: for callers that rank (:func:`top_k` with a k no larger): all that may be among the first
    ``most`` of a (company, n) is there with its exact count, most of the rest is not.
    ``parts``: the counts stay packed (``STORED``: a row for each company and bucket), a task holding one of so many parts of the buckets.
    """
    docs = spread(docs.select("company", text_col))
    wanted = ns or tuple(range(1, max_n + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            yield from _grouped(rows, wanted, stop_words).to_batches(max_chunksize=5_000)

    grouped = docs.select("company", clean_text(F.col(text_col)).alias("clean")).mapInArrow(run, GROUPED)
    if parts:
        return stored(grouped, parts)
    # As many partitions as the session asks for: coalesced by their bytes they would hold too many grams.
    target = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = grouped.repartition(target, "company", "bucket").sortWithinPartitions("company", "bucket")
    return grouped.mapInArrow(lambda batches: _summed(batches, most), "company string, n int, gram string, count bigint")


def stored(packed: DataFrame, parts: int) -> DataFrame:
    """Packed rows with the counts of equal grams added up; part p holds the buckets that leave the rest p, in one task."""
    part = (F.col("bucket") % parts).alias("part")
    return summed_part(packed.select("*", part).repartitionById(parts, "part"))


def summed_part(packed: DataFrame) -> DataFrame:
    """Packed rows of which equal buckets lie in one partition, summed up inside it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[int] = []

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rest[:] = rest or b.column(4)[:1].to_pylist()
                yield pa.RecordBatch.from_arrays(b.columns[:4], b.schema.names[:4])

        for rows in _summed(own(batches), pack=True):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(rest * rows.num_rows, pa.int32())], [*rows.schema.names, "part"])

    rows = packed.select("company", "bucket", "grams", F.col("counts").cast("array<bigint>").alias("counts"), F.col("part").cast("int").alias("part"))
    return rows.sortWithinPartitions("part", "company", "bucket").mapInArrow(run, STORED)


def unpacked(packed: DataFrame) -> DataFrame:
    """(company, n, gram, count) of packed rows, of which equal buckets lie in one partition."""
    rows = packed.select("company", "bucket", "grams", F.col("counts").cast("array<bigint>").alias("counts"))
    return rows.sortWithinPartitions("company", "bucket").mapInArrow(_summed, "company string, n int, gram string, count bigint")


def _summed(batches: Iterator[pa.RecordBatch], most: int | None = None, pack: bool = False) -> Iterator[pa.RecordBatch]:
    """Counts of a partition's grams, its rows sorted by company and bucket: some ``CHUNK`` bytes of whole buckets at once.

    A gram lies in one bucket, so its count is whole here: with ``most``, only those that rank so high among the grams
    counted with them go on, and all that tie with the last of them. ``pack``: as packed rows again, a bucket's grams in order.
    """
    def summed(rows: pa.Table) -> pa.Table:
        # A token holds neither space nor line end: cleaning makes spaces of line ends, and texts are split at spaces.
        grams = pc.split_pattern(rows["grams"].combine_chunks(), "\n")
        company = rows["company"].combine_chunks().dictionary_encode(null_encoding="encode")
        of = pc.list_parent_indices(grams)
        own = pc.take(company.indices, of)
        t = pa.table({"own": own, "gram": grams.flatten(), "count": rows["counts"].combine_chunks().flatten()})
        if pack:
            t = t.append_column("bucket", rows["bucket"].combine_chunks().take(of)).group_by(["own", "bucket", "gram"], use_threads=False).aggregate([("count", "sum")])
            t = t.take(pc.sort_indices(t, [(c, "ascending") for c in ("own", "bucket", "gram")])).combine_chunks()
            group = t["own"].to_numpy().astype(np.int64) * BUCKETS + t["bucket"].to_numpy()
            return _by_bucket(company.dictionary, group, t["gram"].combine_chunks(), t["count_sum"].combine_chunks().cast(pa.int64()))
        t = t.group_by(["own", "gram"], use_threads=False).aggregate([("count", "sum")])
        n = pc.add(pc.count_substring(t["gram"], " "), 1).cast(pa.int32())
        if most is not None:
            keep = pa.array(_leading(t["own"].to_numpy().astype(np.int64) * (1 << 31) + n.to_numpy(), t["count_sum"].to_numpy(), most))
            t, n = t.filter(keep), n.filter(keep)
        return pa.table({"company": company.dictionary.take(t["own"].combine_chunks()), "n": n, "gram": t["gram"], "count": t["count_sum"].cast(pa.int64())})

    held, size, last = [], 0, None
    for batch in batches:
        keys = pa.StructArray.from_arrays(batch.columns[:2], ["company", "bucket"]).to_pylist()
        sizes = pc.binary_length(batch.column(2)).to_pylist()
        start = 0
        for i, key in enumerate(keys):
            if key != last and size >= CHUNK:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield from summed(pa.Table.from_batches(held)).to_batches(max_chunksize=100_000)
                held, size, start = [], 0, i
            size, last = size + sizes[i], key
        held.append(batch.slice(start))
    if held:
        yield from summed(pa.Table.from_batches(held)).to_batches(max_chunksize=100_000)


def _leading(group: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Which rows have one of the ``most`` highest counts of their group, ties included."""
    order = np.lexsort((-count, group))
    group, count = group[order], count[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    keep = np.empty(len(group), bool)
    keep[order] = count >= np.repeat(count[starts + np.minimum(most, sizes) - 1], sizes)
    return keep


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in tables of about ``CHUNK`` bytes of text (a longer text is a table of its own)."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        start = before = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start, before = stop, int(ends[stop - 1])
            if size >= CHUNK or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _grouped(rows: pa.Table, wanted: tuple[int, ...], stop_words: list[str]) -> pa.Table:
    """Grams of a few texts, counted: a row for each company and bucket."""
    company = rows["company"].combine_chunks().dictionary_encode(null_encoding="encode")
    tokens = pc.split_pattern(rows["clean"].combine_chunks(), " ")
    sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    coded = tokens.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()  # numbers in the order of words: neighbours share their beginnings
    words, place = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[coded.indices.to_numpy(zero_copy_only=False)]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # tokens from here to the end of the text
    crc = _hashes(words)

    # A gram of n tokens is (the number of its first n - 1, its last token); of one: (company, token).
    at = np.arange(len(code))
    prefix = np.repeat(company.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    found = []  # for each wanted n: company, bucket, gram, count
    for n in range(1, max(wanted) + 1):
        more = left[at] >= n
        at = at[more]
        key = prefix[more] * len(words) + code[at + n - 1]
        if n < max(wanted):
            numbers, prefix, count = _numbered(key)
        else:
            numbers, count = np.unique(key, return_counts=True)
        parent, last = np.divmod(numbers, max(len(words), 1))
        token = words.take(pa.array(last))
        if n == 1:
            own, bucket, gram = parent, crc[last], token
        else:  # what begins with the same word goes to the buckets of its second word's parts
            own, gram = own[parent], pc.binary_join_element_wise(gram.take(pa.array(parent)), token, " ")
            bucket = bucket[parent] + crc[last] % PARTS * 40_503 if n == 2 else bucket[parent]
        if n in wanted:
            keep = np.ones(len(last), bool) if n > 1 else ~pc.is_in(words, value_set=pa.array(["", *stop_words], pa.string())).to_numpy(zero_copy_only=False)[last]
            found.append((own[keep], bucket[keep] % BUCKETS, gram.filter(pa.array(keep)), count[keep]))
    own, bucket, count = (np.concatenate([f[k] for f in found]) for k in (0, 1, 3))
    group = own * BUCKETS + bucket
    order = np.argsort(group, kind="stable")
    grams = pa.concat_arrays([f[2] for f in found]).take(pa.array(order))
    return _by_bucket(company.dictionary, group[order], grams, pa.array(count[order].astype(np.int32)))


def counts_of(grams: DataFrame, n: int) -> DataFrame:
    """A8/A9/A10 view: (company, <word|bigram|trigram>, count) for one n."""
    return grams.filter(F.col("n") == n).select("company", F.col("gram").alias(NAMES[n]), "count")


def sum_counts(grams: DataFrame) -> DataFrame:
    """(company, n, gram, count) with the counts of equal grams added up; they travel packed, as in :func:`ngram_counts`.

    ``gram`` and ``count`` are as :func:`ngram_counts` makes them, never null.
    """
    target = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return unpacked(packed(grams).repartition(target, "company", "bucket"))


def packed(grams: DataFrame) -> DataFrame:
    """Rows of grams as rows of companies and buckets, not summed up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= CHUNK:
                yield from _packed(pa.Table.from_batches(held)).to_batches(max_chunksize=5_000)
                held, size = [], 0
        if held:
            yield from _packed(pa.Table.from_batches(held)).to_batches(max_chunksize=5_000)

    return grams.select("company", "gram", F.col("count").cast("bigint").alias("count")).mapInArrow(run, GROUPED.replace("array<int>", "array<bigint>"))


def _hashes(words: pa.StringArray) -> np.ndarray:
    """A number below 2**31 for each word, the same wherever it is met."""
    out = np.full(len(words), 0xCBF29CE484222325, np.uint64)
    if not len(words):
        return out.astype(np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data, sizes = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(ends)
    left = np.flatnonzero(sizes)
    for k in range(HASHED):  # byte k of all words that have one
        out[left] = (out[left] ^ data[ends[left] + k]) * np.uint64(0x100000001B3)
        left = left[sizes[left] > k + 1]
    for i in left.tolist():  # few are longer
        out[i] ^= np.uint64(zlib.crc32(data[ends[i] + HASHED:ends[i + 1]]))
    out = (out ^ out >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return (out >> np.uint64(33)).astype(np.int64)


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with inverse and counts; by a table of all keys where there are hardly more of them than rows."""
    if not len(key) or key.max() > 4 * len(key):
        return np.unique(key, return_inverse=True, return_counts=True)
    count = np.bincount(key)
    numbers = np.flatnonzero(count)
    at = np.zeros(len(count), np.int64)
    at[numbers] = np.arange(len(numbers))
    return numbers, at[key], count[numbers]


def _buckets(grams: pa.StringArray) -> np.ndarray:
    """The bucket of each gram, as :func:`_grouped` has it."""
    tokens = pc.split_pattern(grams, " ")
    sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    coded = tokens.flatten().dictionary_encode()
    crc = _hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    first = np.cumsum(sizes) - sizes
    bucket, more = crc[first], sizes > 1
    bucket[more] += crc[first[more] + 1] % PARTS * 40_503
    return bucket % BUCKETS


def _packed(rows: pa.Table) -> pa.Table:
    """Rows of grams as a row for each company and bucket."""
    company, grams = rows["company"].combine_chunks().dictionary_encode(null_encoding="encode"), rows["gram"].combine_chunks()
    group = company.indices.to_numpy(zero_copy_only=False).astype(np.int64) * BUCKETS + _buckets(grams)
    order = np.argsort(group, kind="stable")
    return _by_bucket(company.dictionary, group[order], grams.take(pa.array(order)), rows["count"].combine_chunks().take(pa.array(order)))


def _by_bucket(companies: pa.Array, group: np.ndarray, grams: pa.Array, counts: pa.Array) -> pa.Table:
    """Sorted numbers of (company, bucket), with a gram and its count each, as one row for each number."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[starts, len(group)].astype(np.int32))
    own, bucket = np.divmod(group[starts], BUCKETS)
    return pa.table({"company": companies.take(pa.array(own)), "bucket": pa.array(bucket.astype(np.int32)),
                     "grams": pc.binary_join(pa.ListArray.from_arrays(offsets, grams), "\n"), "counts": pa.ListArray.from_arrays(offsets, counts)})


def merge_counts(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Union state and batch by name, sum counts per key."""
    return sum_counts(state.unionByName(batch))


def top_k(grams: DataFrame, k: int = 100) -> DataFrame:
    """K most frequent grams per (company, n); ties broken by gram ascending."""
    w = Window.partitionBy("company", "n").orderBy(F.col("count").desc(), F.col("gram").asc())
    return (grams.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def top_n_report(grams: DataFrame, n: int, k: int = 20) -> DataFrame:
    """Top k grams first, then the filter, so fewer than k may return.

    Words only need to be non-blank; bigrams and trigrams must be n word-runs.
    """
    top = top_k(grams.filter(F.col("n") == n), k)
    return (top.filter(not_blank(F.col("gram")) if n == 1 else well_formed(F.col("gram"), n))
            .select("company", F.col("gram").alias(NAMES[n]), "count", "rank"))


def to_maps(grams: DataFrame) -> DataFrame:
    """One map<gram, count> per (company, n) (the stored document shape).

    Meant for top-k views (at most k entries per group, as stored); the full
    counts stay a long table, never one map per company.
    """
    return (grams.groupBy("company", "n")
            .agg(F.map_from_entries(F.collect_list(F.struct("gram", "count"))).alias("counts")))


def map_digest(maps: DataFrame) -> DataFrame:
    """Flat, order-independent rendering of A12 maps for comparison."""
    entries = F.array_sort(F.transform(F.map_entries("counts"),
                                       lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return maps.select("company", "n", F.size("counts").cast("bigint").alias("n_entries"),
                       F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"),
                                   lambda a, x: a + x).alias("total"),
                       F.sha2(F.array_join(entries, "\n"), 256).alias("entries_sha"))


def from_maps(maps: DataFrame) -> DataFrame:
    """Unpack stored maps back to rows; no per-word struct fields involved."""
    return maps.select("company", "n", F.explode("counts").alias("gram", "count"))


def top_word(grams: DataFrame) -> DataFrame:
    """Argmax gram per (company, n); the lowest gram wins a tie."""
    return (grams.groupBy("company", "n")
            .agg(F.min_by("gram", F.struct(-F.col("count"), F.col("gram"))).alias("top_gram"),
                 F.max("count").alias("top_count")))
