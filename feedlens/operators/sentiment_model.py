"""a sentiment model fitted and applied by Spark: multinomial naive Bayes over words.

Fitting is two counts over the labelled rows: words by label and rows by label. The
word counts are partial aggregates with one exchange on the word, so a frequent word is one row a
task. Weights are log probabilities with add-one smoothing, kept as whole millionths, so that a
text's sums are exact in any order.

Applying it never moves texts where the model is small: its counted words (at most
``BROADCAST_WORDS``, some 60 bytes each) go to the tasks, and a batch of token arrays is looked up at
once. A larger model is cut into parts of some ``PART_WORDS`` words by a hash of the word. A text sends each part its
words there as one row; a task holds one part at a time while the texts' rows pass by, sorted after it. What comes back is a row
of sums for each text and part, summed up by text and joined back: tokens never travel as rows of their own.

Edge cases: rows with the same id, or none, are told apart by their texts; a null or empty text, or one without known words, has the priors alone; words
the model does not know count nothing; a label without rows has the smoothed prior; an empty
training set gives equal scores, so the first label wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions.score import SENTIMENTS, softmax_label
from feedlens.functions.text import STOP_WORDS, clean_text, tokens, unigrams
from feedlens.operators.ngrams import _chunks
from feedlens.operators.parallel import freed

#: Weights are whole numbers of 1 / UNIT nats.
UNIT = 1_000_000
#: Words up to which the model goes to the tasks whole.
BROADCAST_WORDS = 1_000_000
#: Words of a part of a larger model, and tasks at most that share a part's texts.
PART_WORDS, COPIES = 250_000, 4
#: Rows of token arrays looked up at once.
ROWS = 256

SCHEMA = "word string, " + ", ".join(f"{x} long" for x in SENTIMENTS)


def words_of(text_col: str):
    return unigrams(F.col("_tokens")), tokens(clean_text(F.col(text_col)))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "sentiment") -> DataFrame:
    """The model: a row of weights for each word, and one without word for the priors."""
    rows = labelled.filter(F.col(label_col).isin(*SENTIMENTS)).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    words, split = words_of("text")
    per = [F.count(F.when(F.col("label") == x, 1)).alias(x) for x in SENTIMENTS]
    counts = rows.withColumn("_tokens", split).select("label", F.explode(words).alias("word")).groupBy("word").agg(*per)
    # One row of totals, as a scalar subquery: the counts are read once more, nothing is joined.
    totals = counts.agg(F.struct(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in SENTIMENTS], F.count(F.lit(1)).alias("words"))).scalar()
    by_word = counts.withColumn("_t", totals)
    by_word = by_word.select("word", *[_weight(F.col(x), F.col(f"_t.{x}") + F.col("_t.words")).alias(x) for x in SENTIMENTS])
    prior = rows.agg(*per, F.count(F.lit(1)).alias("n"))
    prior = prior.select(F.lit(None).cast("string").alias("word"), *[_weight(F.col(x), F.col("n") + len(SENTIMENTS)).alias(x) for x in SENTIMENTS])
    return by_word.unionByName(prior)


def _weight(count, of):
    return F.round(F.log((count + 1).cast("double") / of) * float(UNIT)).cast("bigint")


@dataclass
class SentimentModel:
    """A stored model. ``apply`` gives a table ``probabilities`` and ``sentiment``."""

    table: DataFrame
    broadcast_words: int = BROADCAST_WORDS
    copies: int = COPIES
    _held: tuple | None = field(default=None, repr=False)
    _parts: int | None = field(default=None, repr=False)
    _sent: Broadcast | None = field(default=None, repr=False)

    @classmethod
    def fitted(cls, spark: SparkSession, labelled: DataFrame, path: str, broadcast_words: int = BROADCAST_WORDS) -> SentimentModel:
        """Fit on ``labelled`` (text, sentiment), written to ``path`` and read from there."""
        with freed(spark):
            fit(labelled).write.mode("overwrite").parquet(path)
        return cls.stored(spark, path, broadcast_words)

    @classmethod
    def stored(cls, spark: SparkSession, path: str, broadcast_words: int = BROADCAST_WORDS) -> SentimentModel:
        return cls(spark.read.schema(SCHEMA).parquet(path), broadcast_words)

    def held(self) -> tuple[pa.Array, np.ndarray, list[int]] | None:
        """(words, weights, priors) where the model is small, else None; read once."""
        if self._held is None:
            rows = self.table.limit(self.broadcast_words + 2).toArrow()
            if rows.num_rows <= self.broadcast_words + 1:
                weights = np.stack([rows[x].to_numpy() for x in SENTIMENTS], axis=1)
                word = rows["word"].combine_chunks()
                known = word.is_valid().to_numpy(zero_copy_only=False)
                self._held = (word.drop_null(), weights[known], weights[~known][0].tolist())
            else:
                self._held = ()
        return self._held or None

    def logits(self, df: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
        """``df`` with ``logits`` (array of three doubles)."""
        small = self.held()
        return self._looked_up(df, text_col, *small) if small else self._joined(df, text_col, id_col)

    def _looked_up(self, df: DataFrame, text_col: str, word: pa.Array, weights: np.ndarray, priors: list[int]) -> DataFrame:
        if self._sent is None:  # once: a stream asks for every micro-batch, and each broadcast stays on the driver's disk
            self._sent = df.sparkSession.sparkContext.broadcast((word, weights))
        held = self._sent
        words, split = words_of(text_col)
        rows = df.withColumn("_tokens", split).withColumn("_tokens", words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value_set, w = held.value
            w = np.vstack([w, np.zeros((1, len(SENTIMENTS)), np.int64)])  # the last row: no such word
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    b = batch.slice(start, ROWS)
                    lists = b.column(b.num_columns - 1)
                    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=value_set), len(value_set)).to_numpy()
                    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                    sums = np.vstack([np.zeros((1, len(SENTIMENTS)), np.int64), np.cumsum(w[at], axis=0)])
                    total = sums[ends] - sums[np.r_[0, ends[:-1]]] + np.array(priors)
                    logits = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * b.num_rows + 1, 3, dtype=np.int32)), pa.array((total / UNIT).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], logits], [*b.schema.names[:-1], "logits"])

        schema = df.select("*", F.array().cast("array<double>").alias("logits")).schema
        return rows.mapInArrow(run, schema)

    def parts(self) -> int:
        if self._parts is None:
            self._parts = max(1, -(-self.table.count() // PART_WORDS))
        return self._parts

    def _joined(self, df: DataFrame, text_col: str, id_col: str) -> DataFrame:
        parts = self.parts()
        target = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        copies = max(1, min(self.copies, target // parts))
        text, ident = F.col(text_col), F.col(id_col).cast("string")
        asked = df.select(ident.alias("id"), clean_text(text).alias("clean"), F.xxhash64(text).alias("h"), F.pmod(F.xxhash64(ident), F.lit(copies)).cast("int").alias("copy"))
        asked = asked.mapInPandas(lambda frames: _by_part(frames, parts), "id string, h long, copy int, part int, words string, first int")
        none = {x: F.lit(0).cast("long") for x in SENTIMENTS}
        asked = asked.select("part", "copy", F.lit(1).alias("kind"), "id", "h", "first", "words", *[c.alias(x) for x, c in none.items()])
        known = self.table.filter(F.col("word").isNotNull()).withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(copies)])))
        known = known.select((F.crc32(F.col("word").cast("binary")) % parts).cast("int").alias("part"), "copy", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"),
                             F.lit(0).cast("long").alias("h"), F.lit(0).alias("first"), F.col("word").alias("words"), *SENTIMENTS)
        dealt = known.unionByName(asked).repartition(target, "part", "copy").sortWithinPartitions("part", "copy", "kind")
        found = dealt.mapInPandas(_met, "id string, h long, first int, " + ", ".join(f"{x} long" for x in SENTIMENTS))
        # Rows with the same id and text have the same words: their sums are that of each, as often as they are.
        sums = found.groupBy("id", "h").agg(F.sum("first").alias("_n"), *[F.sum(x).alias(f"_{x}") for x in SENTIMENTS]).withColumnsRenamed({"id": "_id", "h": "_h"})
        priors = self.table.filter(F.col("word").isNull()).select(F.struct(*SENTIMENTS)).scalar()
        out = df.withColumn("_prior", priors).withColumn("_own_id", ident).withColumn("_own_h", F.xxhash64(text))  # columns: a key made in the join would carry the text
        out = out.join(sums, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_h") == F.col("_h")), "left")
        logits = F.array(*[(F.coalesce(F.expr(f"_{x} div _n"), F.lit(0)) + F.col(f"_prior.{x}")) / F.lit(float(UNIT)) for x in SENTIMENTS])
        return out.withColumn("logits", logits).select(*[F.col(c) for c in df.columns], "logits")

    def apply(self, df: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
        """F1 by this model: ``df`` with ``probabilities`` and ``sentiment``. ``id_col`` identifies a row."""
        scored = softmax_label(F.col("logits"))
        return self.logits(df, text_col, id_col).withColumn("_s", scored).select(
            *df.columns, F.col("_s.probabilities").alias("probabilities"), F.col("_s.sentiment").alias("sentiment"))


def _by_part(frames: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    """Each text's words as a row for every part that they belong to; the first row of a text says so."""
    kinds = pa.schema([("id", pa.string()), ("clean", pa.string()), ("h", pa.int64()), ("copy", pa.int32())])
    for rows in _chunks(pa.RecordBatch.from_pandas(f, kinds, preserve_index=False) for f in frames):
        split = pc.split_pattern(rows["clean"].combine_chunks(), " ")
        text = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        coded = split.flatten().dictionary_encode()
        word, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        counted = ~pc.is_in(word, value_set=pa.array(["", *STOP_WORDS], pa.string())).to_numpy(zero_copy_only=False)
        part = np.array([zlib.crc32(w.encode()) % parts for w in word.to_pylist()], np.int64)
        text, code = text[counted[code]], code[counted[code]]
        group = text * parts + part[code]
        order = np.argsort(group, kind="stable")
        group = group[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[starts, len(group)].astype(np.int32)), word.take(pa.array(code[order]))), " ")
        text, part = np.divmod(group[starts], parts)
        out = rows.select(["id", "h", "copy"]).take(pa.array(text)).to_pandas()
        yield out.assign(part=part.astype(np.int32), words=words.to_pandas(), first=np.r_[True, text[1:] != text[:-1]].astype(np.int32) if len(text) else part.astype(np.int32))


def _met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the weights of each row's words; a part of the model comes before the rows that ask it."""
    own, known, value_set, weights = None, [], None, None
    for f in frames:
        keys = f[["part", "copy", "kind"]].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(f)], strict=True):
            if a == b:
                continue
            if own != tuple(keys[a, :2]):
                own, known, value_set = tuple(keys[a, :2]), [], None
            rows = f.iloc[a:b]
            if keys[a, 2] == 0:
                known.append((pa.array(rows["words"], pa.string()), rows[list(SENTIMENTS)].to_numpy(np.int64)))
                continue
            if value_set is None:
                value_set = pa.concat_arrays([w for w, _ in known] or [pa.array([], pa.string())])
                weights = np.vstack([*(x for _, x in known), np.zeros((1, len(SENTIMENTS)), np.int64)])  # the last row: no such word
            split = pc.split_pattern(pa.array(rows["words"], pa.string()), " ")
            at = pc.fill_null(pc.index_in(split.flatten(), value_set=value_set), len(value_set)).to_numpy()
            ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
            out = rows[["id", "h", "first"]].copy()
            for k, x in enumerate(SENTIMENTS):
                out[x] = np.diff(np.cumsum(weights[:, k][at])[ends - 1], prepend=0)  # a row has a word at least
            yield out
