"""Counting of n-grams in bounded batches, packed by company and bucket."""

from collections import Counter

import pyarrow as pa
import pytest

from feedlens.functions.text import STOP_WORDS
from feedlens.operators import ngrams as NG

ROWS = [("a", "the  cat the cat"), ("a", ""), ("a", None), (None, "x y z x y z"), (None, None), ("b", " "), ("b", "one"),
        ("b", "é È ß the the "), ("a", "cat the cat"), ("b", "one\ntwo"), ("a", "the  cat the cat")]


def expected(rows, wanted=(1, 2, 3)):
    out = Counter()
    for company, text in rows:
        w = (text or "").replace("\n", " ").lower().split(" ")
        for n in wanted:
            for i in range(len(w) - n + 1):
                if n > 1 or (w[i] and w[i] not in STOP_WORDS):
                    out[company, n, " ".join(w[i:i + n])] += 1
    return out


def found(table):
    got = [(r["company"], r["n"], r["gram"], r["count"]) for r in table]
    assert len(got) == len({x[:3] for x in got})
    return Counter({x[:3]: x[3] for x in got})


@pytest.mark.parametrize("ns", [None, (1,), (2,), (3,), (1, 3)])
def test_counts_every_gram(spark, ns):
    docs = spark.createDataFrame(ROWS, "company string, text string").repartition(3)
    assert found(NG.ngram_counts(docs, ns=ns).collect()) == expected(ROWS, ns or (1, 2, 3))


@pytest.mark.parametrize("chunk", [1, 20, 1_000])
def test_batches_and_buckets_of_any_size_add_up(monkeypatch, chunk):
    monkeypatch.setattr(NG, "CHUNK", chunk)
    clean = [(c, (t or "").replace("\n", " ").lower()) for c, t in ROWS] * 3
    batch = pa.RecordBatch.from_pylist([{"company": c, "clean": t} for c, t in clean], pa.schema([("company", "string"), ("clean", "string")]))
    parts = [NG._grouped(t, (1, 2, 3), STOP_WORDS) for t in NG._chunks(iter([batch, batch.slice(0, 0)]))]
    rows = sorted(pa.concat_tables(parts).to_pylist(), key=lambda r: (r["company"] or "", r["bucket"]))
    grouped = pa.Table.from_pylist(rows, parts[0].schema).to_batches(max_chunksize=4)
    assert found([r for b in NG._summed(iter(grouped)) for r in b.to_pylist()]) == expected(clean)


def test_no_map_of_all_grams_before_the_only_exchange(spark):
    docs = spark.createDataFrame(ROWS, "company string, text string")
    plan = NG.ngram_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_sums_of_counts_travel_packed(spark):
    grams = [("a", 1, "x", 2), ("a", 1, "x", 3), ("a", 2, "x y", 1), (None, 3, "x y z", 4_000_000_000), (None, 3, "x y z", 4_000_000_000), ("b", 2, " ", 1)]
    state = spark.createDataFrame(grams, "company string, n int, gram string, count bigint")
    merged = NG.merge_counts(state.repartition(3), state.limit(1))
    assert "HashAggregate" not in merged._jdf.queryExecution().executedPlan().toString()
    assert found(merged.collect()) == Counter({("a", 1, "x"): 7, ("a", 2, "x y"): 1, (None, 3, "x y z"): 8_000_000_000, ("b", 2, " "): 1})


def test_ranked_grams_leave_the_counting_few_and_exact(spark):
    """Before the window sees them, all grams but those that may be among the first are gone; ties and counts stay exact."""
    rows = [(c, " ".join(f"w{chr(97 + i * j % 26)}{chr(97 + j % 7)}" for j in range(40))) for i in range(60) for c in ("a", "b", None)] + [("d", ""), ("e", None)]
    docs = spark.createDataFrame(rows, "company string, text string")
    whole, few = NG.ngram_counts(docs), NG.ngram_counts(docs, most=5)
    want, got = ({tuple(r) for r in NG.top_k(x, 5).collect()} for x in (whole, few))
    assert want == got and few.count() < whole.count() / 2
    assert {tuple(r) for r in NG.top_word(whole).collect()} == {tuple(r) for r in NG.top_word(NG.ngram_counts(docs, most=1)).collect()}
    assert {tuple(r) for r in few.collect()} <= {tuple(r) for r in whole.collect()}


def test_word_hashes_do_not_depend_on_the_batch():
    words = ["", "a", "b", "ab", "ba", "é", "x" * 32, "x" * 33, "x" * 32 + "y", "long" * 50_000]
    got = NG._hashes(pa.array(words)).tolist()
    assert len(set(got)) == len(words) and min(got) >= 0 and max(got) < 2**31
    assert [NG._hashes(pa.array([w]))[0] for w in words] == got and NG._hashes(pa.array(["zz", *words]).slice(1)).tolist() == got
    assert NG._hashes(pa.array([], pa.string())).tolist() == [] and len({x % NG.BUCKETS for x in NG._hashes(pa.array([f"w{i}" for i in range(20_000)])).tolist()}) == NG.BUCKETS


@pytest.mark.parametrize("top", [5, 10_000])
def test_numbers_of_keys_by_table_and_by_sort(top):
    import numpy as np

    for size in (0, 1, 500):
        key = np.random.default_rng(1).integers(0, top, size)
        for x, y in zip(NG._numbered(key), np.unique(key, return_inverse=True, return_counts=True)):
            assert x.tolist() == y.tolist()
