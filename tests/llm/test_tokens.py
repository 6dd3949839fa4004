"""Operators 4 and 10: against the libraries, exact round trips, packing invariants."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from feedlens.llm import packing, pieces, queries
from .conftest import ODD

SF = "/root/testdata/sf0.001"
BPE, PIECES = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b ", "é😀①ﬁ\n\n c\td", "<s> <0x0A> </s>", "word" * 300, "   ", "x<|endoftext|>y", "a\n b", "a \nb", "foo\n\n bar", "a　 b", "it's  we'll 12 3a!"]


def test_pieces_without_dropout_are_the_models_own(spark):
    plain, sp = pieces.Pieces(PIECES, dropout=0.0), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    for t in [*TEXTS, *(r.text or "" for r in rows)]:
        assert np.frombuffer(plain.encode(t), "<u4").tolist() == sp.encode(t)


def test_dropout_varies_by_seed_and_place_and_decodes(spark):
    one, two = pieces.Pieces(PIECES), pieces.Pieces(PIECES, seed=5)
    text = "internationalisation " * 40
    a, b = one.encode(text), two.encode(text)
    assert a == pieces.Pieces(PIECES).encode(text) != b
    for t in [*TEXTS, "literal ▁ and \x00", "▁", "▁▁ ▁"]:
        assert one.decode(np.frombuffer(one.encode(t), "<u4").tolist()) == t


def test_round_trip_of_the_table_and_of_odd_rows(spark, odd, empty):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        want = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in df.select("text").collect())
        assert sorted(r.decoded_sha256 for r in pieces.round_trip(spark, df, PIECES).collect()) == want
    assert pieces.round_trip(spark, empty, PIECES).count() == 0
    assert pieces.decode(spark, spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PIECES).collect()[0].text == ""


def ids_of(text, library=Tokenizer.from_file(BPE)):
    return library.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check_packing(rows, got, capacity):
    want = []
    for i, t in rows:
        ids = ids_of(t)
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(full), -(-sum(r.length for r in got) // capacity)


def test_packing_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    used, least = check_packing(rows, packing.pack(spark, df, BPE).collect(), packing.CAPACITY)
    assert used <= least * 1.01 + 2


def test_packing_of_odd_rows(spark, odd, empty, make):
    check_packing(ODD, packing.pack(spark, odd, BPE, capacity=7).collect(), 7)
    check_packing([(i, t) for i, t in enumerate(TEXTS)], packing.pack(spark, make(list(enumerate(TEXTS))), BPE).collect(), 1024)
    assert packing.pack(spark, empty, BPE).count() == 0


@pytest.mark.parametrize("capacity", [1, 2, 16, 64])
def test_plans_hold_exactly_the_histogram(capacity):
    rng = np.random.default_rng(capacity)
    for scale in (0, 1, 5, 5000):
        counts = rng.poisson(scale, capacity + 1)
        counts[0] = 0
        held = np.zeros(capacity + 1, int)
        chosen = packing.plan(counts, capacity)
        for need, n in chosen:
            assert n > 0 and sum(k * m for k, m in need.items()) <= capacity
            for k, m in need.items():
                held[k] += m * n
        assert (held == counts).all()
        least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
        assert sum(n for _, n in chosen) <= least * 1.1 + 2


def test_patterns_are_all_exact_fillings_of_up_to_three_lengths():
    lengths = np.array([1, 3, 4, 5, 8, 11, 16])
    want = {(a, b, c) for a in [0, *lengths] for b in [0, *lengths] for c in [0, *lengths] if a >= b >= c and a + b + c == 16}
    got = [tuple(r) for r in packing.patterns(lengths, 16).tolist()]
    assert len(got) == len(set(got)) and set(got) == want


def test_fit_is_the_non_negative_least_squares_solution():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 500, 33)
    counts[0] = 0
    rows = packing.patterns(np.flatnonzero(counts), 32)
    x = packing.fit(rows, counts, rounds=20_000)
    a = np.zeros((33, len(rows)))
    np.add.at(a, (rows.ravel(), np.repeat(np.arange(len(rows)), 3)), 1.0)
    a *= (np.arange(33) / 32)[:, None]
    slope = a.T @ (a @ x - counts * np.arange(33) / 32)
    assert (x >= 0).all() and slope.min() > -1e-3 and np.abs(slope[x > 1e-3]).max() < 1e-3  # the conditions of the optimum


def histogram(sf):
    counts = np.zeros(packing.CAPACITY + 1, np.int64)
    for (t,) in duckdb.sql(f"SELECT text FROM '/root/testdata/{sf}/documents.parquet'").fetchall():
        n = len(ids_of(t))
        counts[(n - 1) % packing.CAPACITY + 1] += 1
        counts[packing.CAPACITY] += (n - 1) // packing.CAPACITY
    return counts


@pytest.mark.parametrize("sf, times, more", [("sf0.01", 1, 1.0), ("sf0.01", 5, 1.0), ("sf0.01", 50, 1.0), ("sf0.001", 50, 1.006)])
def test_fitted_patterns_carry_the_packing(sf, times, more):
    counts = times * histogram(sf)
    rows, x = packing.fitted(counts, packing.CAPACITY)
    assert len(rows) <= (counts > 0).sum()
    chosen = packing.plan(counts, packing.CAPACITY)
    # Sequences of several pieces that come from rounded patterns, among all of several pieces.
    mixed = sum(n for need, n in chosen if sum(need.values()) > 1)
    fitted = int(np.floor(x[rows[:, 1] > 0]).sum())
    assert fitted >= (0.1 if times == 1 else 0.4) * mixed
    assert sum(n for _, n in chosen) <= more * sum(n for _, n in packing.best_fit(counts, packing.CAPACITY))
