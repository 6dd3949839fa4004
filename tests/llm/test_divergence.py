"""Divergence audit: against plain counting, with forced spills and small blocks."""

import random
import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from feedlens.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value string, size long"


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def model(rows, min_docs, ranks=50):
    """rows: (text, lang, source)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(terms_of(text)))
        counts[lang, source].update(terms_of(text))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted(s for g, s in groups if g == lang)
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        of, q = {s: p(counts[lang, s]) for s in sources}, p(total)
        for s in sources:
            pairs = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(q[t] - of[s][t], t) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", over, ranks)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


def random_rows(n, sources, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "naïve", "ÄRGER", "x1y", "don't", "日本", "a_b", "\x7f", "q" * 50, *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 30)))
        # a third of the rows in one group
        source = "hot" if rng.random() < 0.33 else rng.choice([None, "", *(f"s{i}" for i in range(sources))])
        rows.append((text if rng.random() > 0.05 else None, rng.choice(["en", "de", "fr", None]), source))
    return rows


def audited(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, "x", 1, "y", 2) for i, r in enumerate(rows)], SCHEMA)
    out = divergence.audit(spark, df, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, out.collect()))


def test_equals_plain_counting(spark):
    rows = random_rows(400, 6)
    rows += [("lonely words here", "xx", "one"), ("", "yy", "a"), (None, "yy", "b")] + rows[:3]
    assert audited(spark, rows, min_docs=20, ranks=7) == model(rows, 20, 7)
    assert audited(spark, rows, min_docs=1000) == model(rows, 1000)


def test_empty_table(spark):
    assert audited(spark, []) == []


def test_pieces_hold_whole_terms(monkeypatch):
    rng = random.Random(5)
    for size in (1, 3, 10):
        monkeypatch.setattr(divergence, "PIECE", size)
        for _ in range(300):
            text = "".join(rng.choices(["a", "B", " ", "é", "1", "long" * 5, "-"], k=rng.randrange(0, 30)))
            got = [t for part in divergence.pieces_of_terms(text.encode()) for t in part]
            assert [t.decode() for t in got] == terms_of(text)


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_runs_are_spilled_in_order_and_merged(monkeypatch, segment):
    monkeypatch.setattr(divergence, "PIECE", 40)
    monkeypatch.setattr(divergence, "SEGMENT", segment)
    rows = [(t or "", lang or "", s or "") for t, lang, s in random_rows(300, 3)]
    batches = []
    for at in range(0, len(rows), 50):
        t, lang, s = zip(*rows[at:at + 50])
        batches.append(pa.RecordBatch.from_arrays([pa.array(lang), pa.array(s), pa.array([x.encode() for x in t], pa.binary())], ["lang", "source", "text"]))
    runs = [r for b in divergence.spilled(iter(batches), 4, 30) for r in divergence.segments_of(b)]
    assert len({r["run"] for r in runs}) > 10
    assert all(r["terms"] == sorted(r["terms"]) and r["first"] == r["terms"][0] for r in runs)
    runs.sort(key=lambda r: (r["shard"], r["lang"], r["first"], r["run"]))
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        docs[lang].update(set(terms_of(text)))
        counts[lang, source].update(terms_of(text))
    got = {}
    for (_, lang), part in groupby(runs, lambda r: (r["shard"], r["lang"])):
        for f in divergence.merged(part, 15):
            key = lang, f["term"].decode()
            assert key not in got
            got[key] = dict(zip(f["sources"], f["counts"]))
    want = {(lang, t): {s: counts[g, s][t] for g, s in counts if g == lang and counts[g, s][t]}
            for lang, c in docs.items() for t, n in c.items() if n >= 15}
    assert got == want and got


@pytest.mark.parametrize("side", [1, 3, 256])
def test_corrections_in_blocks_of_sources(monkeypatch, side):
    monkeypatch.setattr(divergence, "SIDE", side)
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, (40, 7)) * (rng.random((40, 7)) < 0.3)
    sizes = counts.sum(axis=0) + 5 * 40
    p = 10**9 * (counts + 5) // sizes + 1
    terms = [(np.flatnonzero(c).tolist(), c[c > 0].tolist()) for c in counts]
    got = {(a, b): v for a, b, v in divergence.corrections(terms, sizes)}
    base = divergence.shares(np.zeros((1, 7), np.int64), sizes)[0]
    for a in range(7):
        for b in range(a + 1, 7):
            assert 40 * abs(int(base[a] - base[b])) + got.get((a, b), 0) == np.abs(p[:, a] - p[:, b]).sum()


def test_large_counts_stay_exact():
    counts, sizes = np.array([[10**13, 0]]), np.array([3 * 10**13, 10**18])
    assert divergence.shares(counts, sizes).tolist() == [[1 + 10**9 * (10**13 + 5) // (3 * 10**13), 1]]
