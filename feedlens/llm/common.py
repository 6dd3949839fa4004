"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.session import checkpoint_dir, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words in one shingle, and the similarity from which two texts are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.75

#: Rows up to which a narrow table of ids or keys (16 bytes a row) is broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 500_000

#: Spark's setting by which a query's shuffle files go when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders written inside the open :func:`scratch` blocks, innermost last.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())

_MIX = np.uint64(0x9E3779B97F4A7C15)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII strings take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def written(spark: SparkSession, df: DataFrame, name: str, few: bool = False, stays: bool = False) -> DataFrame:
    """Cut the lineage: ``df`` as a Parquet table in the shared checkpoint folder, read back.

    ``few``: a table that is narrow and far smaller than the input is written by
    no more than two tasks a core, whatever the shuffle's partitions. ``stays``: the
    table outlives the innermost :func:`scratch` block. The shuffle files
    behind the table are removed once it is whole: nothing reads them again.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/feedlens-llm/{name}-{uuid.uuid4().hex}"
    blocks = _SCRATCH.get()[:-1] if stays else _SCRATCH.get()
    if blocks:
        blocks[-1].append(path)
    out = df.coalesce(2 * spark.sparkContext.defaultParallelism) if few else df
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # A plan fixes the setting when it is made: one made under it. Row groups of 16 MB: tables that
        # hold texts are read back by enough tasks.
        out.select("*").write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but for those that stay.

    For operators whose result is a small written table: what led to it is dead then.
    """
    mine: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), mine))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in mine:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast when its counted rows are within BROADCAST_ROWS, else unmarked."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, whatever else the table carries; a null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def numbered(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for every row, and the key's column (a name that is free).

    The key (a long, not negative) follows the order of ``id_col``, null ids last. Where every row
    has such an id of its own, the id is the key: only ids are shuffled to see that. Else rows
    are sorted and written; equal ids are ordered arbitrarily, and spread over tasks however many there are.
    """
    key = free_name(docs, "__row")
    number = F.col(id_col).cast("long")
    ids = docs.select(number.alias("k")).groupBy("k").count()
    if not ids.where("k IS NULL OR k < 0 OR count > 1").limit(1).count():
        return docs.withColumn(key, number), key
    plain = docs.withColumn(key, F.monotonically_increasing_id())
    in_order = plain.orderBy(F.col(id_col).isNull(), number, key)
    return written(spark, in_order.withColumn(key, F.monotonically_increasing_id()), "numbered", stays=True), key


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it needs to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def released() -> None:
    """Give freed memory back to the system: workers are reused by later stages, which have their own needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def python_ready(spark: SparkSession) -> None:
    """Ship the package to the executors' Python workers."""
    ship_package(spark)


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


WORD_HASHES = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z: on UTF-8 bytes both are ASCII operations."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    w = words_of(text)
    return np.fromiter(map(WORD_HASHES.__getitem__, w), np.uint64, len(w))


def mixed(a: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (vectorised)."""
    a = a.copy()
    a ^= a >> np.uint64(30)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(27)
    a *= np.uint64(0x94D049BB133111EB)
    a ^= a >> np.uint64(31)
    return a


def shingle_hashes(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``size`` words, in order; the whole sequence as one when there are fewer; none without words."""
    k = min(size, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for j in range(k):
        s *= _MIX
        s += h[j:j + n]
    return mixed(s)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a slice at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in b.slice(at, 256).columns))
