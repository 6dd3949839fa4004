"""Operator 1: quality by nearest-neighbour voting among latent-semantic vectors.

* A text is a bag of terms: hashed byte trigrams, trigrams of character classes
  (the shape of the text, independent of its language), and repeats of a word by
  its neighbour. Term weights are square roots of shares times an inverse document
  frequency, so long and short texts compare.
* A truncated singular value decomposition of a bounded sample of labelled
  training documents (``SAMPLE`` rows, a documented limit) gives the latent space.
  Only this fit sees a sample; every document is scored on its whole text.
* The labelled latent vectors are broadcast (``SAMPLE * RANK`` floats, fixed).
  Each block of documents is multiplied with all of them: exact cosines, no index.
  The ``K`` nearest neighbours vote with weights that grow with their similarity.

Edge cases: null and empty texts have no terms and get the training share of
label 1, as does every document when nothing is labelled (then 0.5); repeated
rows are scored alike; labels that are null are not learnt from; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.common import fold, free_name, numbered, python_ready, scratch, small, texts, written

SAMPLE, RANK, K = 4000, 48, 15
HASHED, CLASSES = 1024, 7
SHAPE = CLASSES ** 3
TERMS = HASHED + SHAPE + 1

#: Character class of each byte: 0 lower, 1 upper, 2 digit, 3 blank, 4 line break, 5 other ASCII, 6 beyond ASCII.
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[128:] = 0, 1, 2, 3, 4, 6


def terms(text: str | None) -> np.ndarray:
    """Square-root shares of the terms of one text, in three blocks."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    v = np.zeros(TERMS, np.float32)
    b = np.frombuffer(raw, np.uint8)
    if len(b) >= 3:
        w = b.astype(np.uint32)
        code = (w[:-2] * np.uint32(65536) + w[1:-1] * np.uint32(256) + w[2:]) * np.uint32(2654435761)
        v[:HASHED] = np.bincount(code >> np.uint32(22), minlength=HASHED)
        c = _CLASS[b]
        v[HASHED:HASHED + SHAPE] = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=SHAPE)
        v /= len(b) - 2
    words = raw.split()
    if len(words) > 1:
        v[-1] = sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1)
    return np.sqrt(v)


class Model:
    """Latent space and labelled neighbours; picklable and of fixed size."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int = RANK, k: int = K):
        self.prior, self.k = (float(y.mean()) if len(y) else 0.5), k
        self.labels = y.astype(np.float32)
        if not len(x):
            return
        seen = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 1
        a = x * self.idf
        # Randomised subspace iteration for the leading right singular vectors.
        rng = np.random.default_rng(7)
        q = np.linalg.qr(a.T @ (a @ rng.standard_normal((a.shape[1], min(rank + 8, *a.shape))).astype(np.float32)))[0]
        for _ in range(4):
            q = np.linalg.qr(a.T @ (a @ q))[0]
        _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
        self.space = (q @ vt.T)[:, :rank].astype(np.float32)
        self.near = self.latent(x)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.space
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.prior)
        z = self.latent(x)
        cos = z @ self.near.T
        k = min(self.k, cos.shape[1])
        top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, top, 1), 0) ** 8 + 1e-9
        s = (w * self.labels[top]).sum(1) / w.sum(1)
        return np.where(np.abs(x).sum(1) > 0, np.clip(s, 0, 1), self.prior)


def labelled_sample(labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """At most ``rows`` training labels (doc_id, label), the first by hash of the id."""
    lab = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
    lab = lab.where("doc_id IS NOT NULL AND label IS NOT NULL").where(fold(F.col("doc_id"), folds) != 0)
    return lab.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    chosen = labelled_sample(labels, label, sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = [terms(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(vs, pa.binary())], ["doc_id", "label", "v"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(
        vectors, "doc_id long, label int, v binary").collect()  # at most ``sample`` rows (and rows that repeat them)
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["v"])))
    x = np.array([np.frombuffer(r["v"], np.float32) for r in rows]).reshape(-1, TERMS)
    return Model(x, np.array([r["label"] for r in rows], float))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    python_ready(spark)
    docs = texts(docs, id_col, text_col)
    scored = judged(spark, docs, train(spark, docs, labels, sample=sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def judged(spark: SparkSession, docs: DataFrame, fitted: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text)."""
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = np.array([terms(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(x).astype(float))], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def held_out(id_col: Column) -> Column:
    return F.coalesce(fold(id_col, 5) == 0, F.lit(False))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted good.

    Decided by row: rows with one id, or none, are told apart; a row without an id goes when its text is rejected.
    """
    python_ready(spark)
    rows, key = numbered(spark, docs, id_col)
    name = free_name(rows, "__gone")
    with scratch(spark):
        fitted = train(spark, texts(docs, id_col, text_col), labels)
        bad = judged(spark, texts(rows, key, text_col), fitted).where(F.col("score") < threshold)
        bad = written(spark, bad.select(F.col("doc_id").alias(name)), "rejected", stays=True)
    return rows.join(small(bad), rows[key] == bad[name], "left_anti").select(*docs.columns)
