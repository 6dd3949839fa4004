"""Operator 10: best-fit packing of documents into sequences of fixed length.

* **Tokens.** Every text is encoded on the executors and cut into pieces (only
  texts longer than a sequence are cut; the first piece takes the remainder).
  What moves on is one narrow row a piece: ids are hashed, not shuffled.
* **Pattern packing.** The histogram of piece lengths (at most ``capacity``
  rows) is all the driver sees. All patterns of up to three lengths that fill a
  sequence exactly are enumerated, their repeat counts are fitted to the
  histogram by non-negative least squares (errors weighed by length), thinned out
  to as many patterns as lengths, rounded down, and the residual counts are packed
  best-fit decreasing, still as counts.
* **Assignment.** Pieces of one length are interchangeable, so a piece needs only
  its rank among them. Ranks come from windows over (length, hash bucket) plus the
  counts of earlier buckets: a length that a third of all pieces share spreads over
  all buckets. The plan maps (length, rank) to (sequence, offset) by binary search.

Edge cases: null and empty texts are one piece of the end id alone; equal rows
are packed one by one; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from feedlens.llm.common import python_ready, rows_of, texts, written

CAPACITY, END_ID = 1024, 2
#: Fixed value: the split pattern of the byte-level BPE vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """ids of a text as little-endian uint32 bytes, the same ids that ``tokenizers`` gives for the file.

    A split pattern never crosses a single space between two non-spaces, so such a
    text is encoded chunk by chunk and chunks are remembered. Irregular spacing
    encodes the text as a whole; the vocabulary's own special strings go to the
    tokenizers library itself.
    """

    LIMIT = 400_000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.whole = Tokenizer.from_file(path)
        # Printable stand-ins of bytes in byte-level vocabularies.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in self.special}
        self.bpe = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes | None] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *chunks = text.split(" ")
        if first[-1:].isspace():
            return self._plain(text)
        known = self.known
        if len(known) > self.LIMIT:
            known.clear()
        try:
            return self._plain(first) + b"".join([known[c] for c in chunks])
        except KeyError:
            for c in set(chunks):
                if c not in known:
                    known[c] = None if not c or c[0].isspace() or c[-1].isspace() else self._plain(" " + c)
        except TypeError:
            return self._plain(text)
        if any(known[c] is None for c in chunks):
            return self._plain(text)
        return self._plain(first) + b"".join([known[c] for c in chunks])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece of every document: (doc_id, piece, start, length, ids_crc32)."""
    python_ready(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, out = encoder(tokenizer), end_id.to_bytes(4, "little"), []
        for doc_id, text in rows_of(batches):
            ids = encode(text) + end
            n, start = len(ids) // 4, 0
            length = (n - 1) % capacity + 1
            piece = 0
            while start < n:
                out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
                start, piece, length = start + length, piece + 1, capacity
            if len(out) >= 8192:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      ["doc_id", "piece", "start", "length", "ids_crc32"])


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (descending, 0: none) that fill ``capacity`` exactly, of ``lengths`` that occur: all there are.

    At most about capacity ** 2 / 12 rows, whatever the input.
    """
    some = np.concatenate([[0], lengths])
    there = np.zeros(capacity + 1, bool)
    there[some] = True
    a, b = np.meshgrid(lengths, some, indexing="ij")
    c = capacity - a - b
    inside = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[inside], b[inside], c[inside]
    return np.stack([a, b, c], axis=1)[there[c]]


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that minimise sum over lengths of (length * (pieces that x takes - counts)) ** 2.

    Accelerated projected gradient; momentum starts anew where it points uphill. An
    error weighs as its tokens, so what stays over is short pieces, which pack well.
    """
    if not len(rows):
        return np.zeros(0)
    weight = np.arange(len(counts)) / (len(counts) - 1)      # no piece (0) weighs nothing
    share, wanted = weight[rows], counts * weight

    def made(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), (x[:, None] * share).ravel(), minlength=len(counts))

    def along(v: np.ndarray) -> np.ndarray:
        return (v[rows] * share).sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(20):                                      # largest curvature, by power iteration
        u = along(made(v))
        steepest = np.linalg.norm(u)
        v = u / steepest
    x = ahead = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(ahead - along(made(ahead) - wanted) / (1.02 * steepest), 0.0)
        if (ahead - new) @ (new - x) > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, ahead, t = new, new + (t - 1) / after * (new - x), after
    return x


def fitted(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns, no more of them than lengths, and their repeat counts.

    A least-squares solution never needs more patterns than there are lengths, but the
    gradient spreads it over all: the half with the largest counts is kept and fitted
    again until that few are left, so that counts are large enough to round.
    """
    lengths = np.flatnonzero(counts)
    rows = patterns(lengths, capacity)
    x = fit(rows, counts)
    while len(rows) > len(lengths):
        rows = rows[np.argsort(-x, kind="stable")[:max(len(lengths), len(rows) // 2)]]
        x = fit(rows, counts)
    return rows, x


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """[({length: times}, repeats)]: sequences that hold exactly ``counts[length]`` pieces of each length.

    Fitted patterns first, their counts rounded down and bound by the pieces there are; the rest best-fit.
    """
    left = counts.astype(np.int64).copy()
    rows, x = fitted(left, capacity)
    out = []
    for i in np.argsort(-x, kind="stable").tolist():
        lengths, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
        n = min(int(x[i]), int((left[lengths] // times).min()))
        if n > 0:
            out.append((dict(zip(lengths.tolist(), times.tolist())), n))
            left[lengths] -= n * times
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: equal open sequences are one class with a number."""
    spaces: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    for length in np.flatnonzero(left)[::-1].tolist():
        n, space = int(left[length]), length
        while n and space <= capacity:
            if not spaces[space]:
                space += 1
                continue
            need, there = spaces[space].pop()
            fits = min(space // length, -(-n // there))  # times in each of these sequences
            use = min(there, n // fits)
            if use < there:
                spaces[space].append((need, there - use))
            spaces[space - fits * length].append((need | {length: need.get(length, 0) + fits}, use))
            n -= use * fits
            space = length
        if n:
            each = capacity // length
            if n // each:
                spaces[capacity - each * length].append(({length: each}, n // each))
            if n % each:
                spaces[capacity - n % each * length].append(({length: n % each}, 1))
    return [c for s in spaces for c in s]


def slots(chosen: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): ranks [first, first + times * repeats) go to sequences base.. at ``offset``."""
    rank, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for need, n in chosen:
        offset = 0
        for length, times in sorted(need.items(), reverse=True):
            rows.append((length, rank[length], base, times, offset))
            rank[length] += n * times
            offset += length * times
        base += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "base", "times", "offset"), cols))


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    cut = written(spark, pieces(spark, texts(docs, id_col, text_col), tokenizer, capacity, end_id), "pieces")
    n = cut.count()
    parts = int(min(1024, max(16, n // 200_000)))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    # At most capacity * parts rows, whatever the input.
    table = np.zeros((capacity + 1, parts), np.int64)
    for length, bucket, rows in cut.groupBy("length", "bucket").count().collect():
        table[length, bucket] = rows
    where = slots(plan(table.sum(axis=1), capacity), capacity)
    before = np.cumsum(table, axis=1) - table
    keys = where["length"] << 40 | where["first"]
    shared = spark.sparkContext.broadcast((before, keys, where))

    ranked = cut.withColumn("nth", F.row_number().over(
        Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")).cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, keys, where = shared.value
        for b in batches:
            length, bucket, nth = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "bucket", "nth"))
            rank = before[length, bucket] + nth - 1
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            rank = rank - where["first"][at]
            times = where["times"][at]
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(where["base"][at] + rank // times), pa.array(where["offset"][at] + rank % times * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
