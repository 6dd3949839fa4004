r"""Operator 13: fill-in-middle transformation by in-place block rotation.

A text is cut at two token boundaries into prefix, middle and suffix. The
sentinels are inserted where the segments stand, in one bytearray, and two
neighbouring blocks change places by three reversals (each block, then both
together), in place and in pieces of ``BLOCK`` bytes:

* ``psm``: ``<P>prefix <M>middle <S>suffix``, the last two blocks exchanged;
* ``spm``: ``<P>prefix<M>middle <S>suffix``, the first two together against the last.

Restoring finds the three sentinels, rotates back by the same three reversals
and deletes them. A text that holds a sentinel stays plain, and no sentinel can
arise across a cut, so the round trip is exact. Tokens
(``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+``, or spaces that end the text) are scanned on UTF-8 bytes,
where the separators are single bytes, a block at a time: memory is the text's own
bytes whatever its length.

Every row stands for itself: one narrow pass, no shuffle; a lost executor costs its own tasks.

Edge cases: null text is the empty text, which is plain with n = 0; a null
doc_id draws by the hash of ``seed:`` alone; repeated rows are cut alike; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.common import python_ready

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK = 1 << 20
#: Bytes of text after which a batch is handed on.
FLUSH = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def token_ends(text: np.ndarray, at: int) -> np.ndarray:
    """Marks the bytes of the block from ``at`` that end a token of ``text`` (array of bytes)."""
    space = _SPACE[text[at:at + BLOCK + 1]]
    if at + BLOCK < len(text):
        return ~space[:-1] & space[1:]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[-1] = True  # a last word, or the spaces that end the text
    return ends


class Tokens:
    """Number of tokens of a text, and the place after the k-th; holds a count for each block."""

    def __init__(self, text: np.ndarray):
        self.text = text
        self.counts = [int(token_ends(text, at).sum()) for at in range(0, len(text), BLOCK)]
        self.n = sum(self.counts)

    def after(self, k: int) -> int:
        if k == 0:
            return 0
        for i, c in enumerate(self.counts):
            if k <= c:
                return i * BLOCK + int(np.flatnonzero(token_ends(self.text, i * BLOCK))[k - 1]) + 1
            k -= c
        raise IndexError(k)


def reverse(buf: np.ndarray, start: int, end: int) -> None:
    """Reverse ``buf[start:end]`` in place, a block from each side at a time."""
    while end - start > 1:
        k = min(BLOCK, (end - start) // 2)
        head = buf[start:start + k].copy()
        buf[start:start + k] = buf[end - k:end][::-1]
        buf[end - k:end] = head[::-1]
        start, end = start + k, end - k


def exchange(buf: bytearray, start: int, split: int, end: int) -> None:
    """Blocks ``[start, split)`` and ``[split, end)`` change places: three reversals."""
    view = np.frombuffer(buf, np.uint8)
    reverse(view, start, split)
    reverse(view, split, end)
    reverse(view, start, end)


def arranged(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text`` cut at ``first`` and ``second`` (bytes), in ``form`` psm or spm."""
    buf = bytearray(text)
    buf[second:second] = SUFFIX
    buf[first:first] = MIDDLE
    buf[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    exchange(buf, middle if form == "psm" else 0, suffix, len(buf))
    return buf


def original(output: bytes, form: str) -> bytes:
    """The text of which ``output`` was made."""
    if form == "plain":
        return output
    buf = bytearray(output)
    start = buf.index(SUFFIX)
    # Where the two blocks meet now: what came last stands first.
    meet = buf.index(MIDDLE if form == "psm" else PREFIX, start + len(SUFFIX))
    exchange(buf, start, meet, len(buf))
    for mark in (SUFFIX, MIDDLE, PREFIX):  # from the back, so that little moves
        at = buf.index(mark)
        del buf[at:at + len(mark)]
    return bytes(buf)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def characters(part: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return sum(int(np.count_nonzero((part[i:i + BLOCK] & 0xC0) != 0x80)) for i in range(0, len(part), BLOCK))


def cut_row(doc_id: int | None, text: bytes, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    view = np.frombuffer(text, np.uint8)
    tokens = Tokens(view)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return tokens.n, "plain", None, None, text
    first, second = sorted((tokens.after(h1 % (tokens.n + 1)), tokens.after(h2 % (tokens.n + 1))))
    form = "spm" if h4 % 100 < spm else "psm"
    return tokens.n, form, characters(view[:first]), characters(view[first:second]), bytes(arranged(text, first, second, form))


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded bytes; ``text_at`` is the column that holds the text."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[text_at]) + 64
        if size >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def transform(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text, ``rate`` % of them rearranged, of these ``spm`` % suffix first."""
    python_ready(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), *cut_row(i.as_py(), t.as_py(), seed, rate, spm)) for b in batches for i, t in zip(*b.columns))
        yield from _batches(rows, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()],
                            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], 5)

    t = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    out = t.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restore(spark: SparkSession, cut: DataFrame) -> DataFrame:
    """``cut`` (as :func:`transform` gives it) with column ``restored``, rebuilt from ``output`` and ``form`` alone."""
    python_ready(spark)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*(c.as_py() for c in r[:5]), r[5].as_py(), original(r[5].as_py(), r[2].as_py())) for b in batches for r in zip(*b.columns))
        yield from _batches(rows, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()],
                            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"], 5)

    cols = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    out = cut.select(*cols, F.col("output").cast("binary").alias("output")).mapInArrow(
        back, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary")
    return out.select(*cols, F.col("output").cast("string").alias("output"), F.col("restored").cast("string").alias("restored"))


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Both directions over ``docs``: what the texts became, and what was rebuilt from that, as hashes."""
    both = restore(spark, transform(spark, docs))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
