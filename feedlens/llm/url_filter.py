"""Operator 3: allow/block rules for URLs through a Bloom filter cascade.

Native: DataFrame and SQL functions only.

A rule is ``host/path``; it fits its host and all subdomains when the URL's
path starts with the rule's path; the longest fitting rule wins. A URL can
only match keys of the rules' shapes (number of host labels, length of path),
so its candidate keys are one per shape: that many labels from the end of the
host and that many characters of the path.

**Cascade.** The universe is every candidate key of the corpus. Level 1 is a
Bloom filter of the listed keys; level 2 encodes the keys of the universe that
level 1 admits wrongly; level 3 the listed keys that level 2 admits; and so on
until a level admits none wrongly. A key is listed when the first level that
rejects it is an even one. Over its universe the answer is exact, and a scan
asks it with bit tests alone: no join. Level 1 has about log2(universe/listed) bits
a key, later levels a constant number, so the filters follow the list and not the
corpus.

Edge cases: null or malformed URL (no ``://``): empty host and path, no rule;
an empty table or list gives an empty filter; equal rows are judged alike;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.common import LOWER, UPPER, written

#: (verdict, host/path) in the order of the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as plain string cuts."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return (F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit("")))


def shapes(rules: Sequence[tuple[str, str]]) -> list[tuple[int, int]]:
    """Distinct (host labels, path length) of the rules."""
    cut = [r.partition("/") for _, r in rules]
    return sorted({(h.count(".") + 1, len(p) + 1) for h, _, p in cut})


def candidates(host: Column, path: Column, of: Sequence[tuple[int, int]]) -> Column:
    """array<struct<len, host_len, key>> of the keys that rules of these shapes could have."""
    labels = F.size(F.split(host, r"\."))
    found = []
    for k, n in of:
        suffix = F.substring_index(host, ".", -k)
        key = F.concat(suffix, F.substring(path, 1, n))
        found.append(F.when((host != "") & (labels >= k) & (F.char_length(path) >= n),
                            F.struct(F.char_length(key).alias("len"), F.char_length(suffix).alias("host_len"), key.alias("key"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<len:int,host_len:int,key:string>>")


class Level:
    """Bits of one Bloom filter; asked with bit tests on an array literal."""

    def __init__(self, number: int, bits: int, hashes: int, words: dict[int, int]):
        self.number, self.bits, self.hashes = number, bits, hashes
        self.words = [words.get(i, 0) for i in range((bits + 63) // 64)]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number * 1009 + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def admits(self, key: Column) -> Column:
        words, hit = F.lit(self.words).cast("array<bigint>"), F.lit(True)
        for p in self.positions(key):
            hit = hit & (F.expr("1L") == (F.call_function("shiftright", F.get(words, (p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.expr("1L"))))
        return hit


def build_level(keys: DataFrame, number: int, n: int, bits_a_key: float) -> Level:
    """``keys`` has ``n`` rows (column ``key``); its bits are or-ed on the executors, one row a word comes back."""
    bits = max(64, int(math.ceil(n * bits_a_key)))
    level = Level(number, bits, max(1, min(14, round(bits / max(n, 1) * math.log(2)))), {})
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    words = at.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits")).collect()
    return Level(number, bits, level.hashes, {r["w"]: r["bits"] for r in words})


class Cascade:
    """Exact membership of a list over a complete universe of keys."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            # rejected here: not in what this level encodes (odd levels: listed keys, even levels: the others)
            answer = F.when(~level.admits(key), F.lit(level.number % 2 == 0)).otherwise(answer)
        return answer if self.levels else F.lit(False)


def build_cascade(spark: SparkSession, listed: Sequence[str], universe: DataFrame, n_universe: int, most: int = 64) -> Cascade:
    """``universe``: distinct keys (column ``key``). Alternates until a level admits nothing wrongly."""
    if not listed:
        return Cascade([])
    inside = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
    outside = universe.join(F.broadcast(inside), "key", "left_anti")
    n_in, n_out = len(set(listed)), n_universe
    levels: list[Level] = []
    sides, counts = [inside, outside], [n_in, n_out]
    while counts[len(levels) % 2] and len(levels) < most:
        me, other = len(levels) % 2, 1 - len(levels) % 2
        n = counts[me]
        a_key = 1.44 * max(1.0, math.log2(max(counts[1], 2) / max(n, 1))) if not levels else 1.44 * 2
        level = build_level(sides[me], len(levels) + 1, n, a_key)
        levels.append(level)
        sides[other] = sides[other].where(level.admits(F.col("key")))
        counts[other] = sides[other].count()
    if counts[0] and counts[1]:
        raise ValueError(f"the cascade did not settle in {most} levels")
    return Cascade(levels)


def judge_urls(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict); unlisted URLs are allowed."""
    host, path = url_parts(pages[url_col])
    rows = (pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
            .withColumn("keys", candidates(F.col("host"), F.col("path"), shapes(rules))))
    universe = written(spark, rows.select(F.explode("keys").alias("k")).select("k.key").distinct(), "url-keys")
    n = universe.count()
    block = build_cascade(spark, [r for v, r in rules if v == "block"], universe, n)
    allow = build_cascade(spark, [r for v, r in rules if v == "allow"], universe, n)
    judged = F.transform("keys", lambda k: F.struct(
        k["len"].alias("len"), k["host_len"].alias("host_len"), k["key"].alias("key"),
        block.contains(k["key"]).alias("block"), allow.contains(k["key"]).alias("allow")))
    best = F.array_max(F.filter(judged, lambda k: k["block"] | k["allow"]))
    return (rows.withColumn("best", best)
            .select("page_id", "host", "path", F.col("best.key").alias("rule"),
                    F.when(F.col("best.block"), "block").otherwise("allow").alias("verdict")))
