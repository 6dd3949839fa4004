"""Operator 8: n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

A document is the set of its five-word shingles; documents link when
100 * intersection >= 75 * union. The product of the incidence matrix with its
transpose holds all intersections; it is computed block by block of columns
(shingles hashed over the shuffle's partitions), and only where its entries can
reach the bound that the two sizes set, ceil(3 (|x| + |y|) / 7):

* Rows with equal sets are one row (their members stay in a narrow table).
* Columns are put in one global order, rare ones first. The order comes from a
  sketch of document frequencies over the whole corpus (``SKETCH`` counters, a
  fixed size); any order is right, a good one keeps frequent shingles out.
* A row enters only the columns of its first |x| - ceil(3|x|/4) + 1 shingles: two
  rows that share none of these cannot reach the bound. With each entry goes its
  position, so a pair is dropped when what is left of either row is too short.
* Every column links its rows to its first row (round 1): entries, not pairs.
  Rows that verified links already join are one class, and round 2 pairs only rows
  of different classes. So a column of n near-copies costs n
  candidates, while every link between different classes is found.
* Candidates are verified on the whole sets; components follow from the links.

Edge cases: null or wordless text: empty set, linked with nothing; fewer than
five words: the whole sequence is the one shingle; equal rows, ties and repeated
doc_ids are members of one row; a row with a null doc_id links like any other, and its component
is the smallest doc_id of those it reaches, null where all of them are null; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from feedlens.llm.common import free_name, numbered, python_ready, rows_of, scratch, shingle_hashes, small, texts, word_hashes, written
from feedlens.llm.components import components

#: Counters of the frequency sketch: one byte each when broadcast, at any input.
SKETCH = 1 << 24
_SLICE = 1 << 16


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text)))


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n) a document; and at the end of each task its frequency counts in slices (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size, out = np.zeros(SKETCH, np.uint8), [], 0, []

        def add() -> None:
            nonlocal held, size
            if held:
                at, n = np.unique(np.concatenate(held), return_counts=True)
                total[at] = np.minimum(total[at] + n, 255)  # a task's share; only the order of columns depends on it
            held, size = [], 0

        for doc_id, text in rows_of(batches):
            s = shingle_set(text)
            out.append((doc_id, set_key(s) if len(s) else None, len(s), None, None))
            held.append((s & np.uint64(SKETCH - 1)).astype(np.int32))
            size += len(s)
            if size > 500_000:
                add()
            if len(out) >= 4096:
                yield _rows(out)
                out = []
        add()
        out += [(None, None, None, i, total[i * _SLICE:(i + 1) * _SLICE].tobytes()) for i in range(SKETCH // _SLICE)
                if total[i * _SLICE:(i + 1) * _SLICE].any()]
        if out:
            yield _rows(out)

    return docs.mapInArrow(run, "doc_id long, key long, n int, part int, counts binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "key", "n", "part", "counts"])


def frequencies(counts: DataFrame) -> np.ndarray:
    """Logarithmic frequency classes of the whole corpus, summed slice by slice on the executors; SKETCH bytes come back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1)):
                c = np.frombuffer(c.as_buffer(), np.uint8)
                sums[i] = sums[i] + c if i in sums else c.astype(np.uint32)
        classes = [np.minimum(255, np.round(8 * np.log2(1.0 + v))).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(classes, pa.binary())], ["part", "counts"])

    total = np.zeros(SKETCH, np.uint8)
    parts = min(SKETCH // _SLICE, 4 * counts.sparkSession.sparkContext.defaultParallelism)
    for r in counts.repartition(parts, "part").mapInArrow(add, "part int, counts binary").collect():
        total[r["part"] * _SLICE:(r["part"] + 1) * _SLICE] = np.frombuffer(r["counts"], np.uint8)
    return total


def entries(docs: DataFrame, sketch) -> DataFrame:
    """(col, key, n, pos): the entries of each distinct row in the columns of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, out, size = sketch.value, set(), [], 0
        for _, text in rows_of(batches):
            s = shingle_set(text)
            key, n = set_key(s), len(s)
            if not n or key in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add(key)
            k = n - (3 * n + 3) // 4 + 1
            order = np.lexsort((s, df[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))[:k]
            out.append((s[order].view(np.int64), np.full(k, key), np.full(k, n, np.int32), np.arange(k, dtype=np.int32)))
            size += k
            if size > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["col", "key", "n", "pos"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["col", "key", "n", "pos"])

    return docs.mapInArrow(run, "col long, key long, n int, pos int")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, shingles) of the rows whose one member document is in ``wanted`` (doc_id, key); once a task.

    Members without a doc_id are found by their key among all rows that have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = {set_key(s): s.view(np.int64) for s in map(shingle_set, part.column(1).to_pylist()) if len(s)}
                new = [k for k in sets if k not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([sets[k] for k in new], pa.list_(pa.int64()))], ["key", "shingles"])

    # Repeated rows of one doc_id may give a key from several tasks: links are made distinct later.
    chosen = docs.join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    found = chosen.select("doc_id", "text").mapInArrow(run, "key long, shingles array<long>")
    nameless = wanted.where("doc_id IS NULL").select("key").distinct()
    if nameless.isEmpty():
        return found
    rest = docs.where("doc_id IS NULL").select("doc_id", "text").mapInArrow(run, "key long, shingles array<long>")
    return found.unionByName(rest.join(small(nameless), "key", "left_semi"))


_BOUND = "least({a}n - {a}pos, {b}n - {b}pos) >= CAST(ceil(3 * ({a}n + {b}n) / 7) AS INT)"


def verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, reps: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of row keys whose whole sets link."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = written(spark, keys.join(reps, "key").select("doc_id", "key"), f"{name}-wanted", few=True)
    sets = written(spark, sets_of(docs, wanted), f"{name}-sets")
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("x", "y")))
    return written(spark, both.where("100 * i >= 75 * (size(x) + size(y) - i)").select("a", "b"), f"{name}-links", few=True)


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    python_ready(spark)
    docs = texts(docs, id_col, text_col)
    first = written(spark, digests(docs), "digests")
    sketch = spark.sparkContext.broadcast(frequencies(first.where("part IS NOT NULL").select("part", "counts")))
    members = first.where("part IS NULL").select("doc_id", "key", "n")
    reps = members.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    reps = written(spark, reps, "rows")

    column = Window.partitionBy("col")
    table = (entries(docs, sketch).withColumn("rows", F.count(F.lit(1)).over(column))
             .withColumn("pivot", F.min(F.struct("pos", "key", "n")).over(column)).where("rows > 1"))
    table = written(spark, table.select("col", "key", "n", "pos", "pivot"), "columns")
    star = (table.where("key <> pivot.key").where(_BOUND.format(a="", b="pivot."))
            .select(F.greatest("key", "pivot.key").alias("a"), F.least("key", "pivot.key").alias("b")).distinct())
    star = written(spark, star, "star", few=True)
    links = verified(spark, docs, star, reps, "star")

    # Rows that the links so far join are of one class: pairs inside a class add nothing.
    classes = components(spark, links).select(F.col("node").alias("key"), F.col("root").alias("class"))
    table = table.drop("pivot").join(small(classes), "key", "left").withColumn("class", F.coalesce("class", "key"))
    mixed = table.groupBy("col").agg((F.min("class") < F.max("class")).alias("open")).where("open").select("col")
    table = written(spark, table.join(mixed, "col").distinct(), "open-columns")
    pairs = (table.alias("p").join(table.alias("q"), F.expr(
        "p.col = q.col AND p.key > q.key AND p.class <> q.class AND " + _BOUND.format(a="p.", b="q.")))
        .select(F.col("p.key").alias("a"), F.col("q.key").alias("b")).distinct())
    pairs = written(spark, pairs.join(star, ["a", "b"], "left_anti"), "pairs", few=True)
    links = links.unionByName(verified(spark, docs, pairs, reps, "cross"))

    roots = components(spark, links).withColumnRenamed("node", "key")
    rooted = reps.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    low = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    rooted = written(spark, rooted.join(low, "root").select("key", "copies", "component_id"), "rooted")
    # Sets that more than a thousandth of all rows share are at most a thousand: broadcast; the rest joins by key.
    n = members.count()
    hot = rooted.where(F.col("copies") > max(1000, n // 1000)).select("key", F.col("component_id").alias("hot_id"))
    told = members.join(F.broadcast(hot), "key", "left")
    rest = told.where("hot_id IS NULL").drop("hot_id").join(rooted.select("key", "component_id"), "key", "left")
    done = told.where("hot_id IS NOT NULL").select("doc_id", "key", "n", F.col("hot_id").alias("component_id")).unionByName(
        rest.select("doc_id", "key", "n", "component_id"))
    return done.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less all but one row of each component: one with the smallest id, null ids last.

    Decided by row: rows with one id, or none, are told apart by their texts.
    """
    rows, key = numbered(spark, docs, id_col)
    name = free_name(rows, "__gone")
    with scratch(spark):
        gone = (jaccard_components(spark, rows, key, text_col).where("doc_id <> component_id")
                .select(F.col("doc_id").alias(name)))
        gone = written(spark, gone, "gone", stays=True)
    return rows.join(small(gone), rows[key] == gone[name], "left_anti").select(*docs.columns)
