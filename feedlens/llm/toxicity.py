"""Operator 6: toxic spans by a linear-chain conditional random field.

* **Labelled tokens.** Documents carry labels, tokens do not. Over a bounded sample
  of labelled training documents (``TOXIC`` and ``CLEAN`` rows, documented limits; a
  Spark job counts their features) every word and word beginning is tested for an association with toxic
  documents (G-test); tokens of toxic documents that carry a significant one are
  labelled offending, all tokens of clean documents are not.
* **Training.** A two-state chain with hashed emission weights (word, beginnings,
  ending) and transition weights, fitted by gradient ascent on the
  conditional likelihood, whose gradient needs the forward-backward marginals.
* **Scoring.** Exact forward-backward over whole texts. Long chains are cut into
  blocks whose transfer matrices are multiplied, so a batch of any lengths runs
  as array operations. The document score is the largest marginal; tokens from
  ``SPAN`` on are offending, neighbours merge into spans of code point offsets.

Edge cases: null and empty texts have no tokens and score 0.0 with no span; without
labelled toxic documents every score is 0.0; repeated rows are scored alike; labels
that are null are not learnt from; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.common import fold, python_ready, texts, words_of, written
from feedlens.llm.quality import held_out

TOXIC, CLEAN = 1500, 2500
#: Windows of a training document around offending (or similar) tokens, other windows of a clean one, tokens on each side.
HITS, OTHERS, AROUND = 6, 2, 6
WEIGHTS, SIGNIFICANT, OFFENDING, SPAN, BLOCK = 1 << 16, 40.0, 20_000, 0.5, 64
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_TOKEN = re.compile("[^\x20\x09-\x0D]+")


def features(word: bytes) -> list[str]:
    """Word, beginnings and ending of a token without surrounding punctuation."""
    w = word.decode("utf-8", "replace").strip(_STRIP)
    return ["w " + w, *(f"p {w[:k]}" for k in (3, 4, 5, 6) if len(w) > k), "s " + w[-3:]]


def slots(word: bytes) -> list[int]:
    return [xxhash.xxh32_intdigest(f.encode("utf-8", "replace")) % WEIGHTS for f in features(word)]


def offending(counts: DataFrame, toxic: int, clean: int) -> set[str]:
    """Features whose presence is significantly tied to toxic documents (G statistic of ``feature, t, c``)."""
    t, c, n, m = F.col("t"), F.col("c"), float(toxic), float(clean)
    both = t + c
    g = 2 * (t * F.log(t * (n + m) / (n * both)) + F.when(c > 0, c * F.log(c * (n + m) / (m * both))).otherwise(0.0))
    tied = counts.where((t >= 5) & (t / n > 50 * (c + 0.5) / m) & ~F.col("feature").startswith("s ")).where(g > SIGNIFICANT)
    # Each takes part in at least five of ``toxic`` documents; the strongest are kept within a fixed bound.
    return {r["feature"] for r in tied.orderBy(g.desc(), "feature").limit(OFFENDING).collect()}


def marginals(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, block: int | None = None) -> np.ndarray:
    """P(state 1) of every token: ``e`` are state 1's emission scores of concatenated chains of ``lengths`` tokens."""
    out, size_ = np.zeros(len(e)), block or BLOCK
    lengths = lengths.astype(np.int64)
    if not len(e):
        return out
    blocks = -(-lengths // size_)
    chain = np.repeat(np.arange(len(lengths)), blocks)
    first_block = np.cumsum(blocks) - blocks
    nth = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    begin = np.repeat(np.cumsum(lengths) - lengths, blocks) + nth * size_
    size = np.minimum(size_, np.repeat(lengths, blocks) - nth * size_)
    at = begin[:, None] + np.minimum(np.arange(size_), size[:, None] - 1)
    there = np.arange(size_) < size[:, None]
    x = np.exp(np.clip(e[at], -30, 30))                      # emission factor of state 1, state 0 has 1
    a = np.exp(trans)                                        # a[i, j]: from state i to j
    nb = len(size)

    def step(m: np.ndarray, f: np.ndarray, on: np.ndarray) -> np.ndarray:
        new = np.stack([m[..., 0] * a[0, 0] + m[..., 1] * a[1, 0], (m[..., 0] * a[0, 1] + m[..., 1] * a[1, 1]) * f[:, None]], -1)
        return np.where(on[:, None, None], new, m)

    # Transfer matrix of each block from the state before it, rows normalised jointly.
    product = np.broadcast_to(np.eye(2), (nb, 2, 2)).copy()
    for t in range(size_):
        product = step(product, x[:, t], there[:, t])
        product /= product.sum(axis=(1, 2), keepdims=True)
    # Messages into each block: forward from the chain's start, backward from its end.
    into, after = np.zeros((nb, 2)), np.ones((nb, 2))
    opening = np.linalg.solve(a.T, np.exp(start)) if abs(np.linalg.det(a)) > 1e-9 else np.exp(start)
    into[nth == 0] = opening
    for k in range(1, int(blocks.max())):
        b = np.flatnonzero(nth == k)
        v = np.einsum("ni,nij->nj", into[b - 1], product[b - 1])
        into[b] = v / np.abs(v).sum(1, keepdims=True)
    for k in range(int(blocks.max()) - 2, -1, -1):
        b = np.flatnonzero((nth == k) & (np.append(chain[1:], -1) == chain))
        v = np.einsum("nij,nj->ni", product[b + 1], after[b + 1])
        after[b] = v / np.abs(v).sum(1, keepdims=True)
    # Inside the blocks.
    alpha, m = np.zeros((size_, nb, 2)), into
    for t in range(size_):
        new = np.stack([m[:, 0] * a[0, 0] + m[:, 1] * a[1, 0], (m[:, 0] * a[0, 1] + m[:, 1] * a[1, 1]) * x[:, t]], -1)
        m = np.where(there[:, t, None], new / np.abs(new).sum(1, keepdims=True), m)
        alpha[t] = m
    m = after
    for t in range(size_ - 1, -1, -1):
        both = alpha[t] * m
        p = both[:, 1] / np.maximum(both.sum(1), 1e-300)
        on = there[:, t]
        out[at[on, t]] = p[on]
        new = np.stack([a[0, 0] * m[:, 0] + a[0, 1] * x[:, t] * m[:, 1], a[1, 0] * m[:, 0] + a[1, 1] * x[:, t] * m[:, 1]], -1)
        m = np.where(on[:, None], new / new.sum(1, keepdims=True), m)
    return np.clip(out, 0.0, 1.0)


class Crf:
    """Emission weights by feature slot, transitions and start scores of two states."""

    def __init__(self) -> None:
        self.w, self.trans, self.start = np.zeros(WEIGHTS), np.zeros((2, 2)), np.zeros(2)
        self.trained = False

    def fit(self, lengths: np.ndarray, y: np.ndarray, per: np.ndarray, flat: np.ndarray, rounds: int = 50, rate: float = 0.5,
            l2: float = 1e-4) -> Crf:
        """Adagrad ascent on the conditional log-likelihood of chains of ``lengths`` tokens with labels ``y``.

        ``per``: feature slots of each token, ``flat``: the slots.
        """
        self.trained = True
        y = y.astype(float)
        token = np.repeat(np.arange(len(per), dtype=np.int32), per)
        first = np.cumsum(lengths) - lengths
        inner = np.ones(len(y), bool)
        inner[first] = False
        now, g2, t2 = np.flatnonzero(inner), np.full(WEIGHTS, 1e-8), np.full((2, 2), 1e-8)
        want = np.zeros((2, 2))
        np.add.at(want, (y[now - 1].astype(int), y[now].astype(int)), 1)
        for _ in range(rounds):
            e = np.bincount(token, self.w[flat], minlength=len(per))
            p = marginals(e, lengths, self.trans, self.start, block=2 * AROUND + 1)
            grad = np.bincount(flat, (y - p)[token], minlength=WEIGHTS) / 10 - l2 * self.w
            g2 += grad ** 2
            self.w += rate * grad / np.sqrt(g2)
            # Pair expectations from neighbouring marginals (the chain is short-ranged).
            q = np.array([[((1 - p[now - 1]) * (1 - p[now])).sum(), ((1 - p[now - 1]) * p[now]).sum()],
                          [(p[now - 1] * (1 - p[now])).sum(), (p[now - 1] * p[now]).sum()]])
            grad = (want - q) / len(now) - l2 * self.trans
            t2 += grad ** 2
            self.trans = np.clip(self.trans + 0.1 * grad / np.sqrt(t2), -2, 2)
        return self


class Emissions(dict):
    """word -> emission score, remembered up to a bound."""

    def __init__(self, weights: np.ndarray, limit: int = 400_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        v = self[word] = float(self.weights[slots(word)].sum())
        return v


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Crf:
    lab = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("label"))
    lab = (lab.where("doc_id IS NOT NULL AND label IS NOT NULL").where(fold(F.col("doc_id"), 5) != 0)
           .groupBy("doc_id").agg(F.max("label").alias("label")))
    pick = [lab.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic), (0, clean))]
    chosen = pick[0].unionByName(pick[1])

    sample = docs.join(F.broadcast(chosen), "doc_id").select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Documents that have a feature, by label, summed over the task.
        found: list[Counter] = [Counter(), Counter()]
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[min(label, 1)].update({f for w in set(words_of(text)) for f in features(w)})
                found[min(label, 1)][""] += 1  # the documents themselves
        keys = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([found[k][f] for f in keys], pa.int64()) for k in (1, 0))],
                                         ["feature", "t", "c"])

    counts = written(spark, sample.mapInArrow(count, "feature string, t long, c long").groupBy("feature").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c")), "features", few=True)
    n = counts.where("feature = ''").select("t", "c").collect()
    if not n or not n[0]["t"] or not n[0]["c"]:
        return Crf()
    bad = offending(counts, n[0]["t"], n[0]["c"])
    begins = {f[2:5] for f in bad}

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Windows around labelled tokens; in clean documents around tokens that begin like offending ones, and others.
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = list(dict.fromkeys(words_of(text)))
                has = [features(w) for w in ws]
                y = np.array([label > 0 and any(f in bad for f in fs) for fs in has], np.uint8)
                if label:
                    hits = np.flatnonzero(y)[:HITS].tolist()  # none: no token is known to be offending
                else:
                    hits = [i for i, fs in enumerate(has) if any(f[0] == "p" and f[2:5] in begins for f in fs)][:HITS]
                    hits += range(AROUND, min(len(ws), OTHERS * 4 * AROUND), 4 * AROUND)
                for h in hits:
                    part = slice(max(0, h - AROUND), h + AROUND + 1)
                    found = [slots(w) for w in ws[part]]
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (
                        y[part], np.array([len(s) for s in found], np.uint8), np.array([i for s in found for i in s], np.int32))], ["y", "per", "flat"])

    rows = sample.mapInArrow(windows, "y binary, per binary, flat binary").collect()  # bounded by the sample
    rows.sort(key=lambda r: (bytes(r["flat"]), bytes(r["y"])))
    if not rows:
        return Crf()
    y, per, flat = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in (("y", np.uint8), ("per", np.uint8), ("flat", np.int32)))
    if not y.any():
        return Crf()
    return Crf().fit(np.array([len(r["y"]) for r in rows]), y, per.astype(np.int64), flat)


def spans(text: str, p: np.ndarray, least: float = SPAN) -> list[dict]:
    """Runs of tokens from ``least`` on, as {start, end, p} in code points (end exclusive)."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(_TOKEN.finditer(text)):
        if p[i] >= least:
            if last == i - 1:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
            last = i
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def tag(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        threshold: float = 0.5, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row."""
    python_ready(spark)
    docs = texts(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(train(spark, docs, labels, toxic, clean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Emissions(model.w)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                body = part.column("text").to_pylist()
                found = [words_of(t) for t in body]
                lengths = np.array([len(w) for w in found])
                e = np.fromiter((known[w] for ws in found for w in ws), float, int(lengths.sum()))
                p = marginals(e, lengths[lengths > 0], model.trans, model.start) if model.trained else np.zeros(len(e))
                scores, marked, i = [], [], 0
                for t, n in zip(body, lengths.tolist()):
                    own = p[i:i + n]
                    i += n
                    scores.append(float(own.max()) if n else 0.0)
                    marked.append(spans(t, own) if n and scores[-1] >= SPAN else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(marked, _SPANS)],
                                                 ["doc_id", "score", "spans"])

    scored = docs.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "spans")
