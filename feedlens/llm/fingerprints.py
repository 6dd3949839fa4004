"""Operator 7: homomorphic multiset fingerprints of documents.

Native: DataFrame and SQL functions only.

A text is the multiset of its paragraphs (lines). Every paragraph is hashed to
a wide vector, and the fingerprint is the sum of the vectors:

* ``EXACT`` lanes of 32 uniform bits from the whole paragraph, summed modulo
  2**32: equal multisets of paragraphs have equal sums, in any order;
* ``SIGNS`` narrow lanes that hold, for the paragraph's pairs of neighbouring
  words (a lone word for itself), the sum of hashed signs (not reduced): the same kind of sum, whose inner
  product estimates how many runs two texts share (cosine; its standard error for one pair of
  texts is about 1 / sqrt(SIGNS), 0.09);
* the numbers of paragraphs and runs.

Sums only: inserting a paragraph adds its vector, deleting subtracts it
(:func:`combined`), and no text is needed again. All lanes of a text are made
by one pre-aggregated group-by on its row key, so a very long text is a stream
of runs and a hot group has no meaning here.

Edge cases: null text is the empty text (one empty paragraph, no runs); two
texts without runs are alike 1.0 when equal, else 0.0; repeated rows follow
each other (ties of doc_id are ordered by text); the row after the last is the
first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from feedlens.llm.common import texts, written

EXACT, SIGNS = 8, 128
#: Each packed sum holds two sign lanes of 32 bits.
PACKED = SIGNS // 2
_MASK = "4294967297L"  # 1 in each half of a long


def lane_sums(rows: DataFrame, key: str, text: str, weights: dict[str, str]) -> DataFrame:
    """``key`` and, for each prefix p in ``weights`` (prefix -> column of integer weights), its lanes p_e0.., p_s0.., p_n_*.

    Rows of one key add up: a text may come in pieces, and a piece of weight -1
    takes its paragraphs out again.
    """
    lines = rows.select(key, *weights.values(), F.explode(F.split(F.col(text), "\n")).alias("line"))
    hashed = F.expr(r"transform(filter(split(line, '[\\x20\\x09-\\x0D]+'), w -> w != ''), w -> xxhash64(w))")
    whole = lines.select(key, *weights.values(), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    # Words are hashed first and pairs made of their hashes; a lone word stands for itself.
    runs = F.expr("CASE WHEN size(x) > 1 THEN zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x) - 1), (p, q) -> xxhash64(p, q)) ELSE x END")
    pairs = (lines.select(key, *weights.values(), hashed.alias("x")).select(key, *weights.values(), F.explode(runs).alias("h"))
             .withColumn("g", F.xxhash64("h", F.lit(2))))
    # Each sum is a short expression of plain columns: the aggregate stays compiled code. Lanes are
    # summed once for the pieces of equal weights, then weighted.
    lanes = [F.sum(F.expr(f"shiftrightunsigned({'hg'[i // 32]}, {i % 32}) & {_MASK}")).alias(f"s{i}") for i in range(PACKED)]
    runs_of = pairs.groupBy(key, *weights.values()).agg(*lanes, F.count(F.lit(1)).alias("n_runs"))
    exact, signs = [], []
    for p, w in weights.items():
        exact += [F.sum(F.expr(f"{w} * (xxhash64(a, b, {i}) & 4294967295L)")).alias(f"{p}_e{i}") for i in range(EXACT)]
        exact.append(F.sum(w).alias(f"{p}_n_paragraphs"))
        signs += [F.sum(F.expr(f"{w} * {n}")).alias(f"{p}_{n}") for n in (*(f"s{i}" for i in range(PACKED)), "n_runs")]
    runs_of = runs_of.groupBy(key).agg(*signs)
    return whole.groupBy(key).agg(*exact).join(runs_of, key, "left").na.fill(0)


LANES = [*(f"e{i}" for i in range(EXACT)), *(f"s{i}" for i in range(PACKED)), "n_paragraphs", "n_runs"]


def combined(a: str, b: str, sign: int = 1) -> list[Column]:
    """Lanes of a union (``sign`` 1) or difference (-1) of two texts' paragraphs, from their lanes ``a.*`` and ``b.*``."""
    added = {n: F.col(f"{a}.{n}") + sign * F.col(f"{b}.{n}") for n in LANES}
    return [(F.pmod(c, F.lit(1 << 32)) if n[0] == "e" else c).alias(n) for n, c in added.items()]


def as_struct(p: str) -> Column:
    return F.struct(*[(F.col(f"{p}_{n}") % (1 << 32) if n[0] == "e" else F.col(f"{p}_{n}")).alias(n) for n in LANES])


def as_string(prefix: str = "") -> Column:
    """All lanes in hexadecimal."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.col(prefix + n))), 8 if n[0] == "e" else 16, "0") for n in LANES])


def signed(p: str) -> Column:
    """The sums of signs of lanes struct ``p``: twice the set bits less the number of runs, as an array."""
    halves = ", ".join(f"2 * ({p}.s{i} & 4294967295L) - {p}.n_runs, 2 * shiftrightunsigned({p}.s{i}, 32) - {p}.n_runs" for i in range(PACKED))
    return F.expr(f"transform(array({halves}), v -> CAST(v AS INT))")


def likeness(a: str, b: str, same: Column) -> Column:
    """Estimated cosine (0 to 1) of two texts' runs from their arrays of signed sums; 1.0 for equal fingerprints only."""
    a, b = (f"CAST({x} AS ARRAY<DOUBLE>)" for x in (a, b))
    dot = f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (t, v) -> t + v)"
    norms = " * ".join(f"sqrt(aggregate({p}, 0D, (t, v) -> t + v * v))" for p in (a, b))
    return F.when(same, 1.0).otherwise(F.expr(f"coalesce(greatest(0D, least(0.9999D, try_divide({dot}, {norms}))), 0D)"))


def followed(spark: SparkSession, docs: DataFrame, rows_per_range: int = 4096, most_ranges: int = 10_000) -> DataFrame:
    """(row, doc_id, text, n_chars, next_row, head): each row with the beginning of the row that follows by (doc_id, text).

    ``head`` is what replaces the row's last quarter: that many characters of the next text, so that no
    text is written twice.

    Rows are cut into ranges of doc_id (boundaries: approximate quantiles, an
    array of at most ``most_ranges``); a window per range finds the follower,
    and the last row of a range takes the first row of the next range.
    """
    t = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    n = t.select(F.count(F.lit(1)).alias("n")).collect()[0]["n"]
    parts = max(1, min(most_ranges, n // rows_per_range))
    cuts: list[int] = []
    if parts > 1:
        q = t.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts).alias("q")).collect()[0]["q"]
        cuts = sorted(set(q or []))
    # Number of cuts below the id: the sorted literal is searched, nulls first.
    at = F.expr("0")
    if cuts:
        bounds = F.lit(cuts).cast("array<bigint>")
        at = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))))
    t = t.withColumn("part", at.cast("int"))
    w = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    t = (t.withColumn("next_text", F.lead("text").over(w)).withColumn("nth", F.row_number().over(w).cast("long"))
         .withColumn("last", F.lead("n_chars").over(w).isNull()))
    head = F.expr("left(next_text, CAST(n_chars DIV 4 AS INT))")
    t = written(spark, t.withColumn("head", head).drop("next_text"), "followed")
    first = t.where("nth = 1").select("part", "text")
    there = [r["part"] for r in first.select("part").orderBy("part").collect()]  # at most most_ranges + 1
    row = F.shiftleft((F.col("part") + 1).cast("long"), 40) + F.col("nth")
    cols = ["row", "doc_id", "text", "n_chars", "next_row", "head"]
    t = t.withColumn("row", row).withColumn("next_row", F.col("row") + 1)
    if not there:
        return t.select(*cols)
    after = F.create_map(*[F.lit(x) for p, q in zip(there, [*there[1:], there[0]]) for x in (p, q)])
    ends = t.where("last").drop("head", "next_row").withColumn("after", after[F.col("part")])
    heads = first.select(F.col("part").alias("after"), F.col("text").alias("next_text"),
                         (F.shiftleft((F.col("part") + 1).cast("long"), 40) + 1).alias("next_row"))
    ends = ends.join(heads, "after").withColumn("head", head)
    return t.where("NOT last").select(*cols).unionByName(ends.select(*cols))


def fingerprints(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text's sums are the text's, less its last paragraphs, plus the
    edited ones: paragraphs before the edit are hashed once and count in both.
    """
    f = followed(spark, texts(docs, id_col, text_col))
    f = (f.withColumn("k", F.expr("CAST(n_chars DIV 4 AS INT)"))
         .withColumn("stays", F.expr("left(text, CAST(n_chars AS INT) - k)"))
         .withColumn("cut_line", F.substring_index("stays", "\n", -1))
         .withColumn("n_whole", F.expr("char_length(stays) - char_length(cut_line)")))
    f = f.withColumn("head", F.coalesce("head", F.lit("")))
    pieces = F.expr("""filter(array(
        CASE WHEN n_whole > 0 THEN named_struct('body', left(stays, n_whole - 1), 'of_text', 1L, 'of_edited', 1L) END,
        named_struct('body', substring(text, n_whole + 1, CAST(n_chars AS INT)), 'of_text', 1L, 'of_edited', 0L),
        named_struct('body', concat(cut_line, head), 'of_text', 0L, 'of_edited', 1L)), p -> p IS NOT NULL)""")
    sums = lane_sums(f.select("row", F.explode(pieces).alias("p")).select("row", "p.*"), "row", "body",
                     {"t": "of_text", "d": "of_edited"})
    sums = sums.select("row", as_struct("t").alias("t"), as_struct("d").alias("d"))
    # What an edit changed is known here; the next row's side of a comparison is its signs and a digest of its lanes.
    sums = sums.select("row", as_string("t.").alias("t"), as_string("d.").alias("d"), signed("t").alias("t_signs"), signed("d").alias("d_signs"))
    near_edited = likeness("t_signs", "d_signs", F.col("t") == F.col("d"))
    sums = written(spark, sums.select("row", "t", "d", "t_signs", near_edited.alias("near_edited")), "lanes")
    meta = f.select("row", "doc_id", "n_chars", "next_row",
                    F.sha2(F.concat("stays", "head").cast("binary"), 256).alias("edited_sha256"))
    following = sums.select(F.col("row").alias("next_row"), F.md5("t").alias("n"), F.col("t_signs").alias("n_signs"))
    # The narrow rows meet their successors first, so the long strings are shuffled once.
    near = (meta.select("row", "next_row").join(sums.select("row", "t_signs", F.md5("t").alias("t")), "row").join(following, "next_row")
            .select("row", likeness("t_signs", "n_signs", F.col("t") == F.col("n")).alias("near_next")))
    return (meta.drop("next_row").join(sums.drop("t_signs"), "row").join(near, "row")
            .select("doc_id", "n_chars", "edited_sha256", F.col("t").alias("fingerprint"), F.col("d").alias("edited_fingerprint"),
                    "near_edited", "near_next"))
