r"""Operator 12: source divergence audit by single-pass in-memory indexing.

1. **Block postings.** A task reads its documents once and counts, in memory,
   each term's occurrences by (lang, source) and its documents by lang. When the
   block holds ``POSTINGS`` entries it is spilled as a run: for every shard (hash of
   lang and term) the terms in order, with their postings, in segments of at most
   ``SEGMENT`` terms. One row is one segment, so a frequent term is one entry a run
   however many rows hold it, and no key is hot.
2. **Heap merge.** A task gets its shard's segments in the order of their first
   terms and merges them through a heap: a term is done when every segment that is still
   to come begins after it. Only the segments that overlap are held. Terms in at
   least ``MIN_DOCS`` documents of the lang go to the frequency table.
3. **Pair corrections.** Two sources a, b of a lang differ by
   ``V * |a0 - b0|``, a0 being the value of a term the source lacks, corrected
   for the terms that either has. Batches of kept terms are streamed against blocks of
   ``SIDE`` sources, and each gives its sum of corrections.

All values are integers: ``p = 1 + floor(1e9 * (count + 5) / (N + 5 V))`` by 38-digit decimals
in Spark, Python integers or int64 behind a check of the operands in tasks.

Scale: shuffles carry runs (pre-aggregated postings), kept terms and per-batch sums,
never rows of text. Nothing is collected or broadcast by hand: the groups of a lang
travel to that lang's batches by key. The result has a row for each ordered pair of sources of
a lang, and that self-join on lang is the result itself.

Edge cases: null text, lang or source count as ''; a lang without kept terms
gives its pairs value 0; equal documents count as often as they occur; ties of value are ordered by
item (UTF-8); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.llm.common import python_ready, written

#: Documents of a lang that must hold a term; the smoothing; the scale of p; ranks of part ``term``.
MIN_DOCS, PRIOR, UNIT, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Entries (term and source, term and lang) of a block in memory, some 150 bytes each.
POSTINGS = 400_000
#: Terms of one segment; bytes of text tokenised at once.
SEGMENT, PIECE = 2_000, 1 << 20
#: Sources of one block of the pair matrix; cells (terms x sources) of one batch.
SIDE, CELLS = 256, 1 << 18

_TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256))

RUN = "shard int, lang string, first binary, run long, terms array<binary>, docs array<long>, sizes array<int>, sources array<string>, source array<int>, counts array<long>"
_RUN = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("run", pa.int64()), ("terms", pa.list_(pa.binary())),
                  ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("sources", pa.list_(pa.string())),
                  ("source", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
FREQUENCY = "lang string, term binary, sources array<string>, counts array<long>"
_FREQUENCY = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def pieces_of_terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text: other bytes become spaces and A-Z lower case in one pass, a piece at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(_TO_TERMS)
        if end < len(text) and (cut := piece.rfind(b" ")) >= 0:
            end, piece = at + cut + 1, piece[:cut]
        elif end < len(text):  # one term longer than a piece
            piece = text[at:].translate(_TO_TERMS)
            if (cut := piece.find(b" ")) >= 0:
                piece = piece[:cut]
            end = at + len(piece)
        yield piece.split()
        at = end


class Block:
    """Postings in memory."""

    def __init__(self) -> None:
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.docs: dict[str, Counter] = defaultdict(Counter)

    def add(self, lang: str, source: str, text: bytes) -> None:
        seen: set[bytes] = set()
        counts = self.counts[lang][source]
        for terms in pieces_of_terms(text):
            counts.update(terms)
            seen.update(terms)
        self.docs[lang].update(seen)

    def entries(self) -> int:
        return sum(map(len, self.docs.values())) + sum(len(c) for by_source in self.counts.values() for c in by_source.values())

    def segments(self, shards: int, run: int) -> Iterator[pa.RecordBatch]:
        """The block's terms in order, by shard: a batch for each lang."""
        for lang, docs in sorted(self.docs.items()):
            terms = sorted(docs)
            if not terms:
                continue
            names = sorted(self.counts[lang])
            salt = zlib.crc32(lang.encode("utf-8", "surrogatepass"))
            shard = np.fromiter((zlib.crc32(t, salt) % shards for t in terms), np.int32, len(terms))
            order = np.argsort(shard, kind="stable")  # the terms by (shard, term)
            rank = np.empty(len(terms), np.int64)
            rank[order] = np.arange(len(terms))
            place = dict(zip(terms, rank.tolist()))
            by_source = [self.counts[lang][name] for name in names]
            at = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in by_source])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in by_source])
            source = np.repeat(np.arange(len(names), dtype=np.int32), [len(c) for c in by_source])
            postings = np.argsort(at, kind="stable")
            sizes = np.bincount(at, minlength=len(terms)).astype(np.int32)
            # Where segments begin: at a new shard, and at every SEGMENT-th term of a shard.
            shard = shard[order]
            first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            within = np.arange(len(terms)) - np.repeat(first, np.diff(np.r_[first, len(terms)]))
            begin = np.flatnonzero(within % SEGMENT == 0)
            of_terms = pa.array(np.r_[begin, len(terms)].astype(np.int32))
            of_postings = pa.array(np.r_[0, np.cumsum(sizes)][np.r_[begin, len(terms)]].astype(np.int32))
            ordered = pa.array([terms[i] for i in order.tolist()], pa.binary())
            n = len(begin)
            lists = {
                "terms": pa.ListArray.from_arrays(of_terms, ordered),
                "docs": pa.ListArray.from_arrays(of_terms, pa.array(np.fromiter((docs[terms[i]] for i in order.tolist()), np.int64, len(terms)))),
                "sizes": pa.ListArray.from_arrays(of_terms, pa.array(sizes)),
                "sources": pa.array([names] * n, pa.list_(pa.string())),
                "source": pa.ListArray.from_arrays(of_postings, pa.array(source[postings])),
                "counts": pa.ListArray.from_arrays(of_postings, pa.array(count[postings])),
            }
            yield pa.RecordBatch.from_arrays([pa.array(shard[begin]), pa.array([lang] * n, pa.string()), ordered.take(pa.array(begin)),
                                              pa.array([run] * n, pa.int64()), *lists.values()], schema=_RUN)


def spilled(batches: Iterator[pa.RecordBatch], shards: int, postings: int) -> Iterator[pa.RecordBatch]:
    """Runs of a task's documents: (lang, source, text as bytes) in, rows of ``RUN`` out."""
    context = TaskContext.get()
    run = (context.partitionId() if context else 0) << 32
    block, since = Block(), 0
    for batch in batches:
        for lang, source, text in zip(*batch.columns):
            body = text.as_py()
            block.add(lang.as_py(), source.as_py(), body)
            since += len(body)
            if since >= PIECE:  # a byte adds less than one entry
                since = 0
                if block.entries() >= postings:
                    yield from block.segments(shards, run)
                    block, run = Block(), run + 1
    yield from block.segments(shards, run)


def _as_batches(rows: Iterator[dict], schema: pa.Schema, at_once: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class Cursor:
    """Place in a segment; orders by term."""

    __slots__ = ("term", "at", "flat", "row")

    def __init__(self, row: dict):
        self.row, self.at, self.flat = row, 0, 0
        self.term = row["terms"][0]

    def __lt__(self, other: Cursor) -> bool:
        return self.term < other.term

    def take(self, into: dict[str, int]) -> int:
        """Add the postings of the term to ``into``; its documents."""
        row, end = self.row, self.flat + self.row["sizes"][self.at]
        for k in range(self.flat, end):
            into[row["sources"][row["source"][k]]] += row["counts"][k]
        docs, self.flat, self.at = row["docs"][self.at], end, self.at + 1
        self.term = row["terms"][self.at] if self.at < len(row["terms"]) else None
        return docs


def segments_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of ``RUN``, their lists as Python lists; a few rows at a time."""
    for at in range(0, batch.num_rows, 16):
        part = batch.slice(at, 16)
        lists = {}
        for name in ("terms", "docs", "sizes", "source", "counts"):
            column = part.column(name)
            flat = column.flatten()
            values = flat.to_pylist() if name == "terms" else flat.to_numpy().tolist()
            ends = np.cumsum(np.diff(column.offsets.to_numpy())).tolist()
            lists[name] = [values[start:end] for start, end in zip([0, *ends], ends)]
        for i, (shard, lang, first, run, sources) in enumerate(zip(*(part.column(n).to_pylist() for n in ("shard", "lang", "first", "run", "sources")))):
            yield {"shard": shard, "lang": lang, "first": first, "run": run, "sources": sources} | {n: x[i] for n, x in lists.items()}


def merged(rows: Iterator[dict], min_docs: int) -> Iterator[dict]:
    """Frequencies of the terms in ``min_docs`` documents; ``rows``: segments of one (shard, lang) in the order of ``first``."""
    heap: list[Cursor] = []

    def done(before: bytes | None) -> Iterator[dict]:
        while heap and (before is None or heap[0].term < before):
            term, docs, counts = heap[0].term, 0, defaultdict(int)
            while heap and heap[0].term == term:
                top = heap[0]
                docs += top.take(counts)
                if top.term is None:
                    heapq.heappop(heap)
                else:
                    heapq.heapreplace(heap, top)
            if docs >= min_docs:
                names = sorted(counts)
                yield {"term": term, "sources": names, "counts": [counts[n] for n in names]}

    for row in rows:
        yield from done(row["first"])
        heapq.heappush(heap, Cursor(row))
    yield from done(None)


def frequencies(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, postings: int = POSTINGS,
                shards: int | None = None) -> DataFrame:
    """(lang, term, sources, counts): every kept term of every lang, written. ``docs``: lang, source, text without nulls."""
    python_ready(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or 2 * parts

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return spilled(batches, shards, postings)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in segments_of(b))
        by_shard = ((lang, merged(segments, min_docs)) for (_, lang), segments in groupby(rows, lambda r: (r["shard"], r["lang"])))
        yield from _as_batches(({"lang": lang} | term for lang, terms in by_shard for term in terms), _FREQUENCY, 1_000)

    runs = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(spill, RUN)
    dealt = runs.repartition(parts, "shard").sortWithinPartitions("shard", "lang", "first", "run")
    return written(spark, dealt.mapInArrow(merge, FREQUENCY), "frequencies")


def share(count: str, size: str) -> Column:
    """p of a term, exactly; ``size``: N + 5 V."""
    return F.expr(f"CAST(1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + {PRIOR} AS DECIMAL(20,0))) DIV CAST({size} AS DECIMAL(20,0)) AS BIGINT)")


def shares(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """p of counts (terms x sources); sizes: N + 5 V of each source."""
    if len(counts) and counts.max(initial=0) >= (1 << 62) // UNIT:
        exact = UNIT * (counts.astype(object) + PRIOR) // sizes.astype(object)
        return exact.astype(np.int64) + 1
    return UNIT * (counts + PRIOR) // sizes + 1


def corrections(terms: list[tuple[list[int], list[int]]], sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(a, b, sum) for pairs a < b of sources: by how much the terms change the distance of sources that have neither.

    ``terms``: for each, the numbers of its sources and the counts.
    """
    held: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for t, (who, counts) in enumerate(terms):
        for i, c in zip(who, counts):
            held[i // SIDE].append((t, i % SIDE, c))
    blocks = range((len(sizes) + SIDE - 1) // SIDE)
    base = shares(np.zeros((1, len(sizes)), np.int64), sizes)[0]
    for left in blocks:
        for right in blocks[left:]:
            which = sorted({t for b in {left, right} for t, _, _ in held.get(b, ())})
            if not which:
                continue
            place = {t: k for k, t in enumerate(which)}
            p = []
            for b in (left, right):
                size = sizes[b * SIDE:(b + 1) * SIDE]
                counts = np.zeros((len(which), len(size)), np.int64)
                for t, i, c in held.get(b, ()):
                    counts[place[t], i] = c
                p.append(shares(counts, size))
            for i in range(p[0].shape[1]):
                a = left * SIDE + i
                first = i + 1 if left == right else 0
                moved = np.abs(p[1][:, first:] - p[0][:, i:i + 1]).sum(axis=0) - len(which) * np.abs(base[right * SIDE + first:(right + 1) * SIDE] - base[a])
                for j in np.flatnonzero(moved):
                    yield a, right * SIDE + first + int(j), int(moved[j])


def pair_sums(freq: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, moved): sums of corrections of pairs a < b. ``groups``: lang, source, size, terms, n_sources."""
    spread = F.expr(f"CAST(ceil(terms * n_sources / {CELLS}D) AS INT)")
    langs = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.max("n_sources").alias("n_sources"))
    # A batch: terms of a lang by hash, CELLS cells of its table of terms and sources at the mean.
    batches = langs.where("terms > 0").select("lang", spread.alias("n_batches"))
    left = freq.join(batches, "lang").withColumn("batch", F.expr("CAST(pmod(xxhash64(term), n_batches) AS INT)")).drop("n_batches")
    right = groups.join(batches, "lang").withColumn("batch", F.explode(F.expr("sequence(0, n_batches - 1)"))).select("lang", "batch", "source", "size")

    def solve(terms: pa.Table, sources: pa.Table) -> pa.Table:
        order = np.argsort(np.array(sources["source"].to_pylist(), object), kind="stable") if sources.num_rows else []
        sources = sources.take(pa.array(order, pa.int64()))
        names, sizes = sources["source"].to_pylist(), np.array(sources["size"].to_pylist(), np.int64)
        number = {n: i for i, n in enumerate(names)}
        found = list(corrections([([number[n] for n in who], counts) for who, counts in zip(terms["sources"].to_pylist(), terms["counts"].to_pylist())], sizes))
        lang = (sources["lang"] if sources.num_rows else terms["lang"])[0].as_py()
        a, b, moved = zip(*found) if found else ((), (), ())
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array([names[i] for i in a], pa.string()),
                         "b": pa.array([names[i] for i in b], pa.string()), "moved": pa.array(moved, pa.int64())})

    sums = left.groupBy("lang", "batch").cogroup(right.groupBy("lang", "batch")).applyInArrow(solve, "lang string, a string, b string, moved long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("moved").alias("moved"))


def audit(spark: SparkSession, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, ranks: int = TERM_RANKS, postings: int = POSTINGS, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of all pairs of a lang's sources, and each source's most over-used terms."""
    texts = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    freq = frequencies(spark, texts, min_docs, postings, shards)
    uses = freq.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("u")).select("lang", "term", F.col("u.sources").alias("source"), F.col("u.counts").alias("n"))
    of_group = uses.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = freq.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.expr("aggregate(counts, 0L, (t, c) -> t + c)")).alias("lang_n"))
    groups = texts.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "terms", "lang_n"])
    n_sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    groups = written(spark, groups.join(n_sources, "lang").withColumn("size", F.expr(f"n + {PRIOR} * terms"))
                     .withColumn("lang_size", F.expr(f"lang_n + {PRIOR} * terms")), "groups", few=True)

    # Part pair: all terms as if neither had them, then the corrections.
    absent = groups.select("lang", "source", "terms", F.when(F.col("terms") > 0, share("0", "nullif(size, 0)")).otherwise(0).alias("absent"))
    a, b = absent.alias("a"), absent.alias("b")
    pairs = a.join(b, F.expr("a.lang = b.lang AND a.source <> b.source")).select(
        "a.lang", "a.source", F.col("b.source").alias("item"), F.expr("a.terms * abs(a.absent - b.absent)").alias("base"))
    moved = pair_sums(freq, groups)
    both = moved.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "moved").unionByName(
        moved.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "moved"))
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.expr("base + coalesce(moved, 0)").alias("value"))

    # Part term: terms that a source uses more than its lang.
    whole = freq.select("lang", "term", F.expr("aggregate(counts, 0L, (t, c) -> t + c)").alias("all_n"), F.explode(F.arrays_zip("sources", "counts")).alias("u"))
    over = (whole.select("lang", "term", "all_n", F.col("u.sources").alias("source"), F.col("u.counts").alias("n"))
            .join(groups.select("lang", "source", "size", "lang_size"), ["lang", "source"])
            .withColumn("value", share("n", "size") - share("all_n", "lang_size")).where("value > 0")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(over)
