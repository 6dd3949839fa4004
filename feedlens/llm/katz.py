"""Operator 5: Katz backoff scores of documents under a bigram model of the corpus.

Model. Counts come from the training documents. ``P(w) = d(c) c / (N + 1)`` with
Good-Turing discounts d for counts up to ``K``; what is left is the mass of the one
unknown word. ``P(w | h) = d(c) c(h, w) / (C(h) + 1)`` for seen pairs, else
``a(h) P(w)``; the reserved count keeps some mass for backing off and
``a(h) = (1 - sum of seen P(w | h)) / (1 - sum of the same words' P(w))`` makes the
distribution sum to one exactly. Every text starts in the context "begin".

Jobs. Words and contexts are 64-bit hashes. No text is shuffled:

1. *Blocks.* Each task turns its documents into blocks of up to ``BLOCK`` tokens. A
   block holds each distinct pair once (pre-aggregated), with its training count and the
   documents it occurs in, cut into ranges of the second word's hash: the partitioned
   n-gram table, bucketed on shared storage, which later passes read without a shuffle.
2. *Counts of counts.* Per range: c(h, w), c(w), and how many are 1, 2, .. K + 1.
3. *Scores.* Per range, with the discounts known: every document's sum over the pairs of
   this range; for each context the seen mass (for a(h)); for each unseen pair a back-off event. A task's
   worker sends its sums on a few blocks at a time, and the events as one row for each range of the context, whatever the number of blocks.
4. *Back-off.* Per range of the context's hash: a(h), applied to its events, summed by block.
5. Sums by block give the documents' scores.

Hot words and pairs (found on a bounded sample of texts; this decides the layout
only, never a value) are spread over all ranges by context or block; their
few exact totals, summed from all ranges, are broadcast.

Edge cases: null and empty texts are the end token alone; without training
documents N = V = 0, n_known = 0 and every probability is that of the unknown word; repeated rows are
documents of their own; a null doc_id counts as training (it has no remainder); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.common import fold, mixed, python_ready, released, rows_of, texts, words_of, written
from feedlens.session import checkpoint_dir

K = 5
BLOCK = 1_000_000          # tokens held by one task at a time
RANGE_BYTES = 12_000_000   # text bytes per range of words: what a task holds of the n-gram table at a time grows no further
SENT_BYTES = 4_000_000     # a batch that goes to or comes from a worker, about
BUCKET_BITS = 6            # the ranges lie in 2**BUCKET_BITS buckets, one task each
MERGE_BYTES = 64_000_000   # documents' sums that a task gathers over its ranges before it sends them on
HOT_TEXTS, HOT_SHARE, HOT_MOST = 500, 0.002, 500
#: Spark's setting for the bytes of an Arrow batch that goes to a worker.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
END, BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\n end")), np.uint64(xxhash.xxh64_intdigest(b"\n begin"))
_M = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """word -> number in order of first use."""

    def __missing__(self, w: bytes) -> int:
        v = self[w] = len(self)
        return v


def _is_in(values: np.ndarray, sorted_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it in the set, where)."""
    if not len(sorted_set):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values, at


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(h * _M ^ w)


def place(h: np.ndarray, w: np.ndarray, block: int, bits: int, hot: tuple[np.ndarray, ...]) -> np.ndarray:
    """Range of each pair: that of its word; hot words by pair, hot pairs by pair and block."""
    hash_, p = w.copy(), pair_hash(h, w)
    hot_w, _ = _is_in(w, hot[0])
    hash_[hot_w] = p[hot_w]
    hot_p, _ = _is_in(p, hot[1])
    hash_[hot_p] = mixed(p[hot_p] + np.uint64((block * 2 + 1) * int(_M) % (1 << 64)))
    return (hash_ >> np.uint64(64 - bits)).astype(np.int64)


BLOCKS = "block long, range int, words binary, pairs binary, ctx binary, cnt binary, occ binary, docs binary"


def _block_rows(block: int, ids: _Ids, tok: list[np.ndarray], sizes: list[int], doc_ids: list, train: list[bool], bits: int, hot) -> pa.RecordBatch:
    vocab = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))
    n = np.array(sizes, np.int64)  # words and the end
    at_end = np.cumsum(n) - 1
    w = np.empty(int(n.sum()), np.int64)
    inner = np.ones(len(w), bool)
    inner[at_end] = False
    w[inner] = np.concatenate(tok) if tok else 0
    w[~inner] = len(vocab)
    key = w * (len(vocab) + 2)
    key[1:] += w[:-1]
    first = at_end - n + 1
    key[first] = w[first] * (len(vocab) + 2) + len(vocab) + 1
    del w, inner
    vocab = np.append(vocab, [END, BEGIN])
    doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
    # Occurrences in order of (pair); pairs then in order of (range, word).
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    del order
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    occ = np.diff(np.append(start, len(key))).astype(np.uint32)
    cnt = np.add.reduceat(np.array(train, bool)[doc].astype(np.uint32), start).astype(np.uint32)
    key = key[start]
    pw, ph = vocab[key // len(vocab)], vocab[key % len(vocab)]
    ranges = place(ph, pw, block, bits, hot)
    by = np.lexsort((pw, ranges))
    docs = doc[np.argsort(np.repeat(np.argsort(by).astype(np.int32), occ), kind="stable")]
    pw, ph, cnt, occ, ranges = pw[by], ph[by], cnt[by], occ[by], ranges[by]
    ends = np.cumsum(occ.astype(np.int64))
    out = []
    for r in np.unique(ranges).tolist():
        a, b = np.searchsorted(ranges, [r, r + 1])
        words, first = np.unique(pw[a:b], return_index=True)
        d0 = ends[a] - occ[a]
        out.append((block, r, words.tobytes(), np.diff(np.append(first, b - a)).astype(np.uint32).tobytes(),
                    ph[a:b].tobytes(), cnt[a:b].tobytes(), occ[a:b].tobytes(), docs[d0:ends[b - 1]].tobytes()))
    # The documents themselves: range -1.
    known = np.array([i is not None for i in doc_ids], bool)
    out.append((block, -1, np.array([i or 0 for i in doc_ids], np.int64).tobytes(), known.tobytes(), np.array(train, bool).tobytes(),
                n.astype(np.uint32).tobytes(), b"", b""))
    return _batch(out, BLOCKS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], list(names))


def _arr(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


class _Range:
    """Pairs of one range from all blocks, with totals; entries keep the blocks' order."""

    def __init__(self, t: pa.Table, hot, totals=None):
        words, pairs = _arr(t["words"], np.uint64), _arr(t["pairs"], np.uint32)
        self.blocks = t["block"].to_numpy()
        self.h = np.concatenate(_arr(t["ctx"], np.uint64))
        self.w = np.concatenate([np.repeat(a, b) for a, b in zip(words, pairs)])
        cnt = np.concatenate(_arr(t["cnt"], np.uint32))
        self.occ = np.concatenate(_arr(t["occ"], np.uint32))
        self.size = np.array([int(p.sum()) for p in pairs])       # entries of each block
        order = np.lexsort((self.h, self.w)).astype(np.int32)
        self.w, self.h = self.w[order], self.h[order]
        new_w = np.append(True, self.w[1:] != self.w[:-1])
        new_p = new_w | np.append(True, self.h[1:] != self.h[:-1])
        first, first_w = np.flatnonzero(new_p), np.flatnonzero(new_w)
        self.uw, self.uh, self.words = self.w[first], self.h[first], self.w[first_w]
        del self.w, self.h
        self.of = np.empty(len(order), np.int32)                  # entry -> unique pair
        self.of[order] = np.cumsum(new_p, dtype=np.int32) - 1
        cnt = cnt[order]
        del order, new_p, new_w
        self.upair = np.add.reduceat(cnt, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        self.cword = np.add.reduceat(cnt, first_w, dtype=np.int64) if len(first_w) else np.zeros(0, np.int64)
        self.uword = np.repeat(np.arange(len(first_w), dtype=np.int32), np.diff(np.append(np.searchsorted(first, first_w), len(first))))
        del cnt, first, first_w
        self.hot_w, at_w = _is_in(self.words, hot[0])
        self.pair_hashes = pair_hash(self.uh, self.uw) if len(hot[1]) else np.zeros(len(self.uh), np.uint64)
        self.hot_p, at_p = _is_in(self.pair_hashes, hot[1])
        if totals:
            self.cword = np.where(self.hot_w, totals[0][at_w], self.cword) if len(totals[0]) else self.cword
            self.upair = np.where(self.hot_p, totals[1][at_p], self.upair) if len(totals[1]) else self.upair


def _of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c[c > 0], K + 2), minlength=K + 3)[:K + 2]


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing d(r) for r = 0..K+1 (index; the last is 1.0) from counts of counts; 1.0 where the estimate is no discount."""
    d = np.ones(K + 2)
    if n[1] > 0:
        tail = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and tail < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
                d[r] = x if 0 < x < 1 else 1.0
    return d


class Model:
    """Constants of the fitted model."""

    def __init__(self, bigrams: np.ndarray, unigrams: np.ndarray, n: int, v: int):
        self.d2, self.d1, self.n, self.v = discounts(bigrams), discounts(unigrams), n, v
        # Mass of the unknown word: all that the discounted known words leave.
        self.known_mass = None

    def p_word(self, c: np.ndarray) -> np.ndarray:
        return self.d1[np.minimum(c, K + 1)] * c / (self.n + 1)


def hot_keys(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of pairs with at least HOT_SHARE of the tokens of a bounded sample of texts; the pairs' two words."""
    # The sample: whole texts with the smallest hashes; its size does not grow.
    sample = docs.select(F.xxhash64("text").alias("k"), F.substring("text", 1, 20_000).alias("t")).orderBy("k").limit(HOT_TEXTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs: Counter = Counter()
        for b in batches:
            for t in b.column("t").to_pylist():
                ws = words_of(t)
                words.update(ws)
                pairs.update(zip(ws, ws[1:]))
        total = max(1, sum(words.values()))
        rows = [(0, w, None) for w, c in words.items() if c >= HOT_SHARE * total]
        rows += [(1, a, b) for (a, b), c in pairs.items() if c >= HOT_SHARE * total]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["kind", "a", "b"])

    h = lambda x: xxhash.xxh64_intdigest(bytes(x))
    rows = sample.select("t").coalesce(1).mapInArrow(count, "kind int, a binary, b binary").collect()
    words = np.unique(np.array([int(END), *sorted({h(r["a"]) for r in rows if r["kind"] == 0})[:HOT_MOST]], np.uint64))
    pairs = np.array([(h(r["a"]), h(r["b"])) for r in rows if r["kind"] == 1][:HOT_MOST], np.uint64).reshape(-1, 2)
    pairs = pairs[_is_in(pairs[:, 0], words)[0] & _is_in(pairs[:, 1], words)[0]]  # both words of a hot pair are hot
    hashed, first = np.unique(pair_hash(pairs[:, 0], pairs[:, 1]), return_index=True)
    return words, hashed, pairs[first, 0], pairs[first, 1]


class _Tables:
    """Bucketed tables in the shared folder, dropped with :meth:`drop` when later results no longer need them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, {}

    def write(self, df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
        table = f"feedlens_{name}_{uuid.uuid4().hex}"
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/feedlens-llm/{table}"
        (df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, by).saveAsTable(table))
        self.made[name] = (table, path)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        table, path = self.made.pop(name)
        self.spark.sql(f"DROP TABLE {table}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, hold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, str(SENT_BYTES))  # a range's rows are megabytes each: not all of them in one batch
    try:
        return _scored(spark, docs, id_col, text_col, folds, hold)
    finally:
        spark.conf.unset(_BATCH_BYTES) if before is None else spark.conf.set(_BATCH_BYTES, before)


def _scored(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, folds: int, hold: int) -> DataFrame:
    python_ready(spark)
    docs = texts(docs, id_col, text_col)
    docs = docs.withColumn("held", F.coalesce(fold(F.col("doc_id"), folds) == hold, F.lit(False)))
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    bits = max(BUCKET_BITS, int(np.ceil(np.log2(max(1, size / RANGE_BYTES)))))
    hot, tables = hot_keys(docs), _Tables(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, nth = (TaskContext.get().partitionId() + 1) << 20, 0
        ids, tok, sizes, doc_ids, train, total = _Ids(), [], [], [], [], 0
        for doc_id, text, held in rows_of(batches):
            w = words_of(text)
            tok.append(np.fromiter(map(ids.__getitem__, w), np.int64, len(w)))
            sizes.append(len(w) + 1)
            doc_ids.append(doc_id)
            train.append(not held)
            total += len(w) + 1
            if total >= BLOCK:
                yield _block_rows(base + nth, ids, tok, sizes, doc_ids, train, bits, hot)
                released()
                ids, tok, sizes, doc_ids, train, total, nth = _Ids(), [], [], [], [], 0, nth + 1
        if sizes:
            yield _block_rows(base + nth, ids, tok, sizes, doc_ids, train, bits, hot)
            released()

    found = docs.select("doc_id", "text", "held").mapInArrow(blocks, BLOCKS)
    found = found.withColumn("bucket", F.shiftright("range", bits - BUCKET_BITS))
    grams = tables.write(found, "grams", "bucket", 1 << BUCKET_BITS)
    ranges = grams.where("range >= 0").groupBy("bucket", "range")

    def counts(t: pa.Table) -> pa.Table:
        r = _Range(t, hot)
        real = ~r.hot_w
        row = [_of_counts(r.upair[~r.hot_p]), _of_counts(r.cword[real]),
               np.array([r.cword[real].sum(), (r.cword[real] > 0).sum()])]
        rows = [("n", np.concatenate(row).astype(np.int64).tobytes(), b"")]
        for kind, key, c in (("w", r.words[r.hot_w], r.cword[r.hot_w]), ("p", r.pair_hashes[r.hot_p], r.upair[r.hot_p])):
            if len(key):
                rows.append((kind, key.tobytes(), c.tobytes()))
        released()
        return pa.Table.from_batches([_batch(rows, "kind string, a binary, b binary")])

    # One short row a range, and the totals of at most HOT_MOST words and pairs.
    found = ranges.applyInArrow(counts, "kind string, a binary, b binary").collect()
    stats = sum((np.frombuffer(r["a"], np.int64) for r in found if r["kind"] == "n"), np.zeros(2 * (K + 2) + 2, np.int64)).copy()
    totals = []
    for kind, keys in (("w", hot[0]), ("p", hot[1])):  # exact totals of hot keys
        sums = np.zeros(len(keys), np.int64)
        for r in found:
            if r["kind"] == kind:
                np.add.at(sums, np.searchsorted(keys, np.frombuffer(r["a"], np.uint64)), np.frombuffer(r["b"], np.int64))
        totals.append(sums)
    two, one = stats[:K + 2] + _of_counts(totals[1]), stats[K + 2:2 * K + 4] + _of_counts(totals[0])
    n_train, v = int(stats[-2] + totals[0].sum()), int(stats[-1] + (totals[0] > 0).sum())
    model = Model(two, one, n_train, v)
    # Known words with a count up to K weigh d(c) c; the others c.
    lost = sum(int(one[r]) * r * (1 - model.d1[r]) for r in range(1, K + 1))
    p_unknown = (1 + lost) / (n_train + 1)
    n_docs = docs.where("NOT held").count()

    OUT = "kind string, dest int, block long, a binary, b binary, c binary, d binary"

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        r = _Range(t, hot, totals)
        here = int(t["range"][0].as_py())
        cp, cw = r.upair, r.cword[r.uword]
        p1 = np.where(cw > 0, model.p_word(cw), p_unknown)
        seen = np.where(cp > 0, model.d2[np.minimum(cp, K + 1)] * cp, 0.0)
        # The pair's own part, and 1 / (C(w) + 1) for the pair that follows it.
        part = np.where(cp > 0, np.log10(np.maximum(seen, 1e-300)), np.log10(p1))
        base = np.log10(cw + 1.0)
        part -= np.where(r.uw == END, 0.0, base)
        rows, at, size = [], 0, 0
        unseen = cp == 0
        docs_in = _arr(t["docs"], np.uint32)
        events: list[tuple[np.ndarray, ...]] = []
        for i, block in enumerate(r.blocks.tolist()):
            e = slice(at, at + int(r.size[i]))
            at += int(r.size[i])
            u, d = np.repeat(r.of[e], r.occ[e]), docs_in[i].astype(np.int64)
            some = np.flatnonzero(np.bincount(d)).astype(np.uint32)  # documents of the block that have pairs here
            sums = np.bincount(d, part[u])[some], np.bincount(d, base[u])[some], np.bincount(d, cw[u] > 0)[some].astype(np.uint32)
            rows.append(("d", here, block, *(x.tobytes() for x in sums), some.tobytes()))
            size += 24 * len(some)
            if size >= SENT_BYTES:
                yield _batch(rows, OUT)
                rows, size = [], 0
            back = unseen[u]
            if back.any():
                events.append((r.uh[u[back]], d[back].astype(np.uint32), np.full(int(back.sum()), block)))
        del t, docs_in
        if events:
            # Events by range of their context; those of hot contexts stay here.
            h, who, of = (np.concatenate(x) for x in zip(*events))
            far = np.where(_is_in(h, context_hot)[0], here, (h >> np.uint64(64 - bits)).astype(np.int64))
            o = np.argsort(far, kind="stable")
            h, who, of, far = h[o], who[o], of[o], far[o]
            for x in np.unique(far).tolist():
                a, b = np.searchsorted(far, [x, x + 1])
                rows.append(("u", x, 0, h[a:b].tobytes(), who[a:b].tobytes(), of[a:b].tobytes(), b""))
                size += 20 * (b - a)
                if size >= SENT_BYTES:
                    yield _batch(rows, OUT)
                    rows, size = [], 0
            del h, who, of, far, o
        del events
        # Seen mass of each context, under both orders, by range of the context. A hot pair
        # is in many ranges: its mass is added once, on the driver.
        known = (cp > 0) & ~r.hot_p
        ctx, back = np.unique(r.uh[known], return_inverse=True)
        s2, s1 = np.bincount(back, seen[known], len(ctx)), np.bincount(back, p1[known], len(ctx))
        is_hot, _ = _is_in(ctx, context_hot)
        if is_hot.any():
            rows.append(("h", here, 0, ctx[is_hot].tobytes(), s2[is_hot].tobytes(), s1[is_hot].tobytes(), b""))
        rows += _cut(ctx[~is_hot], [s2[~is_hot], s1[~is_hot]], "c", bits)  # doubles: a frequent context backs off with a mass near 1 / C
        # Counts of words as contexts: at home here, unless hot.
        home = (r.cword > 0) & ~_is_in(r.words, context_hot)[0]
        rows += _cut(r.words[home], [r.cword[home]], "n", bits)
        del r, cp, cw, p1, seen, part, base, unseen, known, back, ctx, s1, s2
        if rows:
            yield _batch(rows, OUT)
        del rows
        released()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of one block's documents over all ranges of the task are one row: they do not grow with the ranges.
        held: dict[int, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for block, v in held.items():
                yield _batch([("d", block % (1 << bits), block, *(x.tobytes() for x in v), b"")], OUT)
            held.clear()

        for t in batches:
            is_d = np.array([k == "d" for k in t["kind"].to_pylist()], bool)
            if not is_d.all():
                yield t.filter(pa.array(~is_d))
            t = t.filter(pa.array(is_d))
            for i, block in enumerate(t["block"].to_pylist()):
                some = np.frombuffer(t["d"][i].as_buffer(), np.uint32)
                sums = held.get(block)
                if sums is None or len(sums[0]) <= some[-1]:
                    grown = [np.zeros(int(some[-1]) + 1, x) for x in (np.float64, np.float64, np.uint32)]
                    for x, y in zip(grown, sums or []):
                        x[:len(y)] = y
                    sums = held[block] = grown
                for x, c, kind in zip(sums, "abc", (np.float64, np.float64, np.uint32)):
                    x[some] += np.frombuffer(t[c][i].as_buffer(), kind)
            if sum(x.nbytes for v in held.values() for x in v) > MERGE_BYTES:
                yield from flush()
        yield from flush()
        released()

    context_hot = np.unique(np.append(hot[0], BEGIN))
    parts = tables.write(ranges.applyInArrow(scores, OUT).mapInArrow(merged, OUT), "scores", "dest", 1 << BUCKET_BITS)
    # The scores hold all that is needed of the n-gram table but the documents of each block: the table can go.
    rows = written(spark, grams.where("range = -1").select(F.lit("r").alias("kind"), "block", F.col("words").alias("a"), F.col("pairs").alias("b"),
                                                           F.col("ctx").alias("c"), F.col("cnt").alias("d")), "blocks")
    tables.drop("grams")
    counts_hot = np.where(context_hot == BEGIN, n_docs, 0)
    is_w, at_w = _is_in(context_hot, hot[0])
    counts_hot = np.where(is_w, totals[0][at_w], counts_hot)
    mass = np.zeros((2, len(context_hot)))
    for row in parts.where("kind = 'h'").select("a", "b", "c").collect():  # at most HOT_MOST + 2 contexts a range
        at = np.searchsorted(context_hot, np.frombuffer(row["a"], np.uint64))
        np.add.at(mass[0], at, np.frombuffer(row["b"], np.float64))
        np.add.at(mass[1], at, np.frombuffer(row["c"], np.float64))
    c_w = totals[0][_is_in(hot[3], hot[0])[1]] if len(hot[3]) else np.zeros(0, np.int64)
    at, there = np.searchsorted(context_hot, hot[2]), totals[1] > 0
    np.add.at(mass[0], at[there], (model.d2[np.minimum(totals[1], K + 1)] * totals[1])[there])
    np.add.at(mass[1], at[there], model.p_word(c_w)[there])
    hot_weight = _back_off(counts_hot, mass[0], mass[1])

    def backed(t: pa.Table) -> pa.Table:
        kind = t["kind"].to_numpy(zero_copy_only=False)
        pick = lambda k: t.filter(pa.array(kind == k))
        c, n, u = pick("c"), pick("n"), pick("u")
        if not len(u):
            return pa.Table.from_batches([], pa.schema([("kind", pa.string()), ("dest", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in "abcd")]))
        cat = lambda x, k: np.concatenate(x) if x else np.zeros(0, k)
        words, total = cat(_arr(n["a"], np.uint64), np.uint64), cat(_arr(n["b"], np.int64), np.int64)
        o = np.argsort(words)
        words, total = words[o], total[o]
        h, s2, s1 = cat(_arr(c["a"], np.uint64), np.uint64), cat(_arr(c["b"], np.float64), np.float64), cat(_arr(c["c"], np.float64), np.float64)
        there, at = _is_in(h, words)
        at = at[there]
        weight = _back_off(total, np.bincount(at, s2[there], len(words)), np.bincount(at, s1[there], len(words)))
        rows = _by_block(_arr(u["c"], np.int64), _arr(u["a"], np.uint64), _arr(u["b"], np.uint32), ((words, weight), (context_hot, hot_weight)))
        del c, n, u, words, total, h, s2, s1, there, at, weight
        released()
        return pa.Table.from_batches([_batch(rows, OUT)])

    corrected = (parts.where("kind IN ('c', 'n', 'u')").groupBy("dest").applyInArrow(backed, OUT))
    start = -np.log10(n_docs + 1.0)
    norm = np.log10(float(n_train + v + 1))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One block: its parts are added up as they come; at most one row says which documents it has.
        sums = {"a": np.zeros(0), "b": np.zeros(0), "c": np.zeros(0, np.int64)}
        documents = []
        for t in batches:
            for i, kind in enumerate(t["kind"].to_pylist()):
                if kind == "r":
                    documents.append([np.frombuffer(t[k][i].as_buffer(), x).copy() for k, x in (("a", np.int64), ("b", bool), ("c", bool), ("d", np.uint32))])
                    continue
                if kind == "b":  # back-offs of some documents
                    some = np.frombuffer(t["b"][i].as_buffer(), np.uint32)
                    if some[-1] >= len(sums["a"]):
                        sums["a"] = np.append(sums["a"], np.zeros(int(some[-1]) + 1 - len(sums["a"])))
                    sums["a"][some] += np.frombuffer(t["a"][i].as_buffer(), np.float64)
                    continue
                for name, x in (("a", np.float64), ("b", np.float64), ("c", np.uint32)):
                    v = np.frombuffer(t[name][i].as_buffer(), x)
                    if len(v) > len(sums[name]):
                        sums[name] = np.append(sums[name], np.zeros(len(v) - len(sums[name]), sums[name].dtype))
                    sums[name][:len(v)] += v.astype(sums[name].dtype)
        for ids, known, train, n in documents:
            s, b, k = (np.append(v, np.zeros(len(ids) - len(v), v.dtype)) for v in sums.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~known), pa.array(~train), pa.array(n.astype(np.int64)), pa.array(k),
                 pa.array(np.full(len(ids), n_train)), pa.array(b - n * norm), pa.array(s + start)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sums = parts.where("kind = 'd'").unionByName(corrected).select("kind", "block", "a", "b", "c", F.lit(None).cast("binary").alias("d"))
    return rows.unionByName(sums).groupBy("block").applyInArrow(
        gathered, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _back_off(total: np.ndarray, seen2: np.ndarray, seen1: np.ndarray) -> np.ndarray:
    """log10 of (C + 1) a(h): replaces the 1 / (C + 1) of a seen pair by the back-off weight."""
    left = 1 - seen2 / (total + 1.0)
    return np.log10(np.maximum(left, 1e-12)) - np.log10(np.maximum(1 - seen1, 1e-12)) + np.log10(total + 1.0)


def _by_block(blocks: list, events: list[np.ndarray], documents: list[np.ndarray], weights: tuple) -> list[tuple]:
    """A row for each block, however many ranges its back-off events come from: sums of the documents that have any.

    ``blocks``: of each array of events, one block or a block an event.
    """
    h, who = np.concatenate(events), np.concatenate(documents)
    block = np.concatenate([np.broadcast_to(b, len(e)) for b, e in zip(blocks, events)])
    x = np.zeros(len(h))
    for keys, w in weights:
        inside, at = _is_in(h, keys)
        x[inside] = w[at[inside]]
    order = np.lexsort((who, block))
    block, who, x = block[order], who[order], x[order]
    first = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (who[1:] != who[:-1])))
    block, who, x = block[first], who[first], np.add.reduceat(x, first)
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    return [("b", 0, int(block[a]), x[a:b].tobytes(), who[a:b].tobytes(), b"", b"") for a, b in zip(cuts, cuts[1:])]


def _cut(keys: np.ndarray, values: list[np.ndarray], kind: str, bits: int) -> list[tuple]:
    """Rows of sorted ``keys`` by range of the key."""
    rows, dest = [], (keys >> np.uint64(64 - bits)).astype(np.int64)
    for x in np.unique(dest).tolist():
        a, b = np.searchsorted(dest, [x, x + 1])
        v = [y[a:b].tobytes() for y in values] + [b""]
        rows.append((kind, x, 0, keys[a:b].tobytes(), v[0], v[1], b""))
    return rows
