"""Operators 8 and 2, and components: against brute force on small tables."""

import collections
import itertools

import numpy as np
import pytest

from feedlens.llm import jaccard_join, windows
from feedlens.llm.components import components

SF = "/root/testdata/sf0.001"


def words(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    return sorted(((i, len(s), min(low[find(k)], default=None)) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def got_components(spark, df):
    return sorted((tuple(r) for r in jaccard_join.jaccard_components(spark, df).collect()), key=str)


def test_components_match_brute_force_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got_components(spark, df) == brute_components(rows)


def test_components_of_near_copies_ties_and_odd_texts(spark, make):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab, 90).tolist() for _ in range(4)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A B"), (6, "b a"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (8, "z " * 500)]
    for k in range(60):  # a chain of edits: far ends are alike only through others
        b = base[k % 4]
        for _ in range(int(rng.integers(0, 4))):
            b[int(rng.integers(0, len(b)))] = str(rng.choice(vocab))
        rows.append((100 + k, " ".join(b)))
    rows += [(200 + k, " ".join(base[0][:60] + [f"only{k}"] * 30)) for k in range(10)]  # one common passage
    assert got_components(spark, make(rows)) == brute_components(rows)


def test_rows_without_an_id_link_and_bridge(spark, make):
    base = [f"w{i}" for i in range(100)]

    def edited(k, prefix="e"):
        return " ".join([f"{prefix}{i}" if i >= 100 - k else w for i, w in enumerate(base)])

    alone = " ".join(f"u{i}" for i in range(60))
    rows = [(None, edited(1)), (9, edited(0)),                # a near-copy without an id
            (20, edited(14)), (None, edited(27)), (None, edited(27)), (None, alone), (None, alone + " tail"), (None, None)]
    rows += [(5, " ".join(f"b{i}" for i in range(100))), (None, " ".join([f"b{i}" for i in range(87)] + [f"m{i}" for i in range(13)])),
             (3, " ".join([f"b{i}" for i in range(79)] + [f"t{i}" for i in range(8)] + [f"m{i}" for i in range(13)]))]
    want = brute_components(rows)
    assert got_components(spark, make(rows)) == want
    assert {(i, c) for i, _, c in want if i is not None} >= {(5, 3), (3, 3), (9, 9)}  # 5 and 3 meet only through the row without an id


def test_kept_row_is_the_first_of_its_component(spark, make):
    text = " ".join(f"w{i}" for i in range(80))
    df = make([(1, "else"), (5, text), (3, text + " tail"), (9, text.upper()), (None, "no id at all")])
    out = jaccard_join.keep_first(spark, df)
    assert out.columns == df.columns and sorted(out.toPandas()["text"]) == ["else", "no id at all", text + " tail"]


def test_components_of_a_long_path(spark):
    order = np.random.default_rng(1).permutation(200).tolist()
    links = spark.createDataFrame([*zip(order, order[1:]), (500, 501), (501, 500)], "a long, b long")
    got = {r.node: r.root for r in components(spark, links).collect()}
    assert got == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}


def test_empty_and_odd_tables(spark, empty, odd):
    assert jaccard_join.jaccard_components(spark, empty).count() == 0
    assert windows.passages(spark, empty).count() == 0
    assert windows.passages(spark, odd).count() == 0
    assert windows.without_repeats(spark, odd).count() == 13


@pytest.mark.parametrize("n", [1, 19, 20, 64, 333])
def test_compact_windows_are_cartesian_tree_nodes(n):
    rng = np.random.default_rng(n)
    key = rng.integers(1, 1 << 39, n).astype(np.uint64) << np.uint64(24) | np.arange(n, dtype=np.uint64)
    key[rng.integers(0, n, n // 100)] = 0
    want = []
    for c in range(n):
        left = right = c
        while key[c] and left > 0 and key[left - 1] > key[c]:
            left -= 1
        while key[c] and right < n - 1 and key[right + 1] > key[c]:
            right += 1
        if key[c] and right - left + 1 >= 20:
            want.append((c, left, right))
    assert sorted(zip(*(x.tolist() for x in windows.compact_windows(key, key, 20)))) == want


def test_every_exact_repeat_of_51_words_is_found(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, words(r.text)) for r in df.select("doc_id", "text").collect()]
    rows.sort()
    first, later = {}, set()
    for i, w in rows:
        for k in range(len(w) - 50):
            if first.setdefault(tuple(w[k:k + 51]), i) != i:
                later.add(i)
    found = windows.passages(spark, df).collect()
    assert later <= {r.doc_id for r in found}
    texts = dict(rows)
    for r in found:  # each match is a near-duplicate passage by its words
        a, b = (set(map(tuple, (w[k:k + 5] for k in range(len(w) - 4)))) for w in (texts[r.doc_id][r.start:r.end], texts[r.match_id][r.match_start:r.match_end]))
        assert r.doc_id > r.match_id and min(r.end - r.start, r.match_end - r.match_start) >= 50
        assert len(a & b) / len(a | b) >= 0.75


def test_a_passage_in_many_documents_and_pairs_hidden_behind_it(spark, make):
    rng = np.random.default_rng(2)
    own = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    common, pair = own(60), own(70)
    rows = [(i, " ".join(own(40) + common + own(30))) for i in range(30)]
    rows += [(40, " ".join(own(20) + pair + own(5))), (41, " ".join(own(80) + pair)), (42, " ".join(own(200)))]
    edited = pair.copy()
    edited[35] = "changed"
    rows.append((43, " ".join(edited)))
    found = {(r.doc_id, r.match_id) for r in windows.passages(spark, make(rows)).collect()}
    assert {i for i, _ in found} == {*range(1, 30), 41, 43}
    out = {r.doc_id: words(r.text) for r in windows.without_repeats(spark, make(rows)).collect()}
    assert len(out) == len(rows) and all(len(out[i]) == 70 for i in range(1, 30)) and len(out[0]) == 130
    assert len(out[41]) == 80 and len(out[43]) == 0 and len(out[42]) == 200
