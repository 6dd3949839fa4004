"""Operators 3, 7 and 9: against brute force, edge cases, and native plans."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from feedlens.llm import exact_dedup, fingerprints, queries, url_filter
from .conftest import ODD

SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"key_bits": 3, "bucket_rows": 2}, {"key_bits": 1, "bucket_rows": 1}])
def test_exact_groups_with_chains_and_splits(spark, odd, options):
    got = exact_dedup.exact_groups(spark, odd, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(ODD)


def test_hot_copies_use_overflow_pages(spark, make):
    rows = [(i, "Same text" if i % 3 else f"text {i}") for i in range(300)]
    got = exact_dedup.exact_groups(spark, make(rows), bucket_rows=10)
    assert sorted((tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == brute_groups(rows)


def test_directory_doubles_only_where_full():
    slots, chained = exact_dedup.directory({0: 100, 1: 1, 8: 1, 15: 1}, bucket_rows=10, max_depth=4)
    assert len(slots) == 16 and len(set(slots[8:])) == 1 and chained == [slots[0]]
    assert exact_dedup.directory({}, 10) == ([0], [])


def test_kept_rows_keep_their_columns(spark, make):
    df = make([(1, "A"), (2, "a"), (3, "b"), (None, "c")])
    out = exact_dedup.keep_last(spark, df)
    assert out.columns == df.columns and sorted(out.toPandas()["text"]) == ["a", "b", "c"]


def rule_of(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = low(rest[:cut]), rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(r), r, v) for v, r in url_filter.RULES for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [None, "", "nothing", "://", "http://", "http://COM/", "https://a.b.com/x?y#z", "http://example.com/en/", "http://www.example.com/en/q",
        "http://x.www.example.com/en/q", "http://example.com/en", "http://example.com?/en/", "http://net/es/", "http://a.net/es/1", "http://a.net/ES/",
        "http://anet/es/", "http://.com/", "http://com./", "ftp://u@h.net:80/fr/", "http://a.net/fr/#x", "http://a.net#/fr/", "x http://a.com/ http://b.net/es/",
        "http://a.com/\nb?c", "http://a..com/", "http://é.NET/es/"]


def test_urls_match_brute_force(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[5], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark, pages).collect()}
    assert got == {(i, *rule_of(u)) for i, u, _ in rows}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 5000, 41)]
    cascade = url_filter.build_cascade(spark, listed, universe, 5000)
    assert len(cascade.levels) > 1
    hits = {r.key for r in universe.where(cascade.contains(F.col("key"))).collect()}
    assert hits == set(listed)


def test_fingerprints(spark, odd):
    got = fingerprints.fingerprints(spark, odd).collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[:len(t) - k] + nxt[:k]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all((r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1) for r in got)


def test_fingerprints_by_many_ranges_equal_one(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r.doc_id: r for r in fingerprints.fingerprints(spark, df).collect()}
    followed = fingerprints.followed
    monkeypatch.setattr(fingerprints, "followed", lambda s, d: followed(s, d, rows_per_range=9))
    assert {r.doc_id: r for r in fingerprints.fingerprints(spark, df).collect()} == one
    assert sum(r.near_edited for r in one.values()) / len(one) > 0.6 > 0.2 > sum(r.near_next for r in one.values()) / len(one)


def test_fingerprint_is_a_multiset_homomorphism(spark):
    body = ["b one two", "a b c d", "a b c d", "", "long " * 50]
    rows = spark.createDataFrame([(1, "\n".join(body), 1), (2, "\n".join(sorted(body)), 1), (3, body[0], 1), (3, "\n".join(body[1:]), 1),
                                  (4, "\n".join([*body, "extra line"]), 1), (4, "extra line", -1), (5, "\n".join(body[1:]), 1)], "row long, body string, w long")
    lanes = fingerprints.lane_sums(rows, "row", "body", {"t": "w"}).select("row", fingerprints.as_struct("t").alias("t"))
    got = {r.row: r.t for r in lanes.collect()}
    assert got[1] == got[2] == got[3] == got[4] != got[5]


@pytest.mark.parametrize("name", ["op3_url_filter", "op7_fingerprints", "op9_exact_dedup"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan and "Cartesian" not in plan


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_groups(spark, empty).count() == 0
    assert fingerprints.fingerprints(spark, empty).count() == 0
    assert url_filter.judge_urls(spark, spark.createDataFrame([], "page_id long, url string")).count() == 0
