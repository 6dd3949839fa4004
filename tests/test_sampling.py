"""Exact seedless sampling: cuts found through bucket histograms equal a plain row_number cut, hot stratum included."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlens.operators.datasets import balance, cuts, md5_key, split_balanced, stratified_split, until, with_cuts


def _frame(spark):
    rows = [(str(i), "hot" if i % 3 else f"c{i % 7}", "neutral" if i % 5 == 0 else "positive")
            for i in range(3000)]
    return spark.createDataFrame(rows, "id string, company string, sentiment string")


def first_k(df, keys, k_of_n, **options):
    table = cuts(df, keys, lambda t: t.withColumn("k", k_of_n(F.col("n"))), **options)
    return {r.id for r in with_cuts(df, keys, table).filter(until("k")).collect()}


def test_cuts_match_row_number(spark):
    df = _frame(spark)
    w = Window.partitionBy("company").orderBy(md5_key(), F.col("id"))
    ranked = df.withColumn("r", F.row_number().over(w)).select("id", "r").collect()
    for k in (-1, 0, 1, 777, 10**6):
        assert first_k(df, ["company"], lambda n: F.lit(k), bucket_hex=1) == {r.id for r in ranked if r.r <= k}  # noqa: B023
    assert first_k(df, ["company"], lambda n: F.lit(None).cast("long")) == set()


def test_rows_of_a_split_do_not_move(spark):
    """Only histograms, and the buckets that hold a cut, are exchanged; the rows meet their cuts by broadcast."""
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    split, balanced = text(stratified_split(_frame(spark))), text(split_balanced(_frame(spark)))
    for plan in (split, balanced):
        top = plan[:plan.index("BroadcastExchange")]  # what the rows go through before they are decided
        assert "Window" not in top and "Sort" not in top and plan.count("Window [") == 1
        assert plan.count("BroadcastHashJoin") >= 2
    assert "Exchange hashpartitioning" not in split[:split.index("BroadcastExchange")]


def test_balance_up_and_down(spark):
    df = _frame(spark)
    out = balance(df)
    counts = {(r.company, r.sentiment): r.n for r in out.groupBy("company", "sentiment").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    for (company, sentiment), n in counts.items():
        if sentiment == "neutral":
            assert n == counts[(company, "positive")]


def test_balance_company_without_neutral_or_others(spark):
    rows = [("1", "a", "positive"), ("2", "a", "positive"), ("3", "b", "neutral"), ("4", "b", "neutral")]
    df = spark.createDataFrame(rows, "id string, company string, sentiment string")
    got = sorted((r.id, r.copy) for r in balance(df).collect())
    assert got == [("1", 1), ("2", 1), ("3", 1), ("4", 1)]


def hot_items(spark, n):
    """Three quarters of the rows are of one company, and two thirds of these of one day; some keys are NULL."""
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 4 else None if i % 8 else "cold", f"v{i}", (i * 7) % 13,
             base + dt.timedelta(hours=(i * 5) % 200) if i % 3 == 0 else base + dt.timedelta(days=2, seconds=(i * 11) % 977)) for i in range(n)]
    return spark.createDataFrame(rows, "company string, item string, n_comments int, item_order timestamp_ntz")


def test_prior_total_matches_plain_window(spark):
    """The parallel prefix sum equals one window over the whole key (hot key and NULL key included)."""
    from feedlens.operators.datasets import prior_total

    df = hot_items(spark, 800)
    w = Window.partitionBy("company").orderBy("item_order", "item").rowsBetween(Window.unboundedPreceding, -1)
    want = {(r.company, r.item): r.p for r in df.withColumn("p", F.coalesce(F.sum("n_comments").over(w), F.lit(0))).collect()}
    for pieces in (None, 1, 13):
        out = prior_total(df, ["company"], ["item_order", "item"], "n_comments", pieces=pieces)
        assert out.columns == [*df.columns, "prior_total"]
        assert {(r.company, r.item): r.prior_total for r in out.collect()} == want
    assert prior_total(df.limit(0), ["company"], ["item_order", "item"], "n_comments").count() == 0


def test_hot_day_of_a_company_is_cut_into_pieces(spark):
    """One company and day holds half of all rows: no task and no window gets much more than its share."""
    from feedlens.operators.datasets import PIECE, in_pieces

    n, pieces = 20_000, 20
    d = in_pieces(hot_items(spark, n), ["company"], ["item_order", "item"], pieces)
    day = d.filter("company = 'hot' AND to_date(item_order) = '2024-01-03'")
    per_piece = [r["count"] for r in d.groupBy(PIECE).count().collect()]
    assert day.count() > n / 2 and sum(per_piece) == n
    assert max(per_piece) < 2 * n / pieces and day.select(PIECE).distinct().count() >= pieces / 2
    # pieces follow the order: their ranges don't overlap
    ends = d.filter("company = 'hot'").groupBy(PIECE).agg(F.min(F.struct("item_order", "item")).alias("a"), F.max(F.struct("item_order", "item")).alias("b")).orderBy(PIECE).collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))


def test_replicate_counts(spark):
    from feedlens.operators.parallel import replicate

    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 250)], "k string, times bigint")
    out = replicate(df, "times", "copy", chunk=100)
    got = {r.k: (r.n, r.lo, r.hi) for r in out.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.min("copy").alias("lo"), F.max("copy").alias("hi")).collect()}
    assert got == {"b": (1, 1, 1), "c": (250, 1, 250)}


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(sizes=st.lists(st.integers(min_value=1, max_value=300), min_size=1, max_size=5),
       frac=st.floats(min_value=0.0, max_value=1.0))
def test_cuts_property(spark, sizes, frac):
    """For random strata sizes and cut points the bucketed cut equals row_number() <= k."""
    rows = [(f"{s}-{i}", f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, company string")
    k = lambda n: F.floor(n * F.lit(frac)).cast("bigint")
    got = first_k(df, ["company"], k, bucket_hex=1)
    w = Window.partitionBy("company").orderBy(md5_key(), F.col("id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("company"))
    want = {r.id for r in df.withColumn("r", F.row_number().over(w)).withColumn("n", n)
            .filter(F.col("r") <= F.floor(F.col("n") * F.lit(frac))).collect()}
    assert got == want


def test_nearest_ties_and_small_groups(spark):
    """Equal distances rank by id; a group with fewer than k items returns what it has."""
    from feedlens.operators.retrieval import nearest

    rows = [("c", "positive", "youtube", 1, [1.0, 0.0]), ("c", "positive", "youtube", 2, [1.0, 0.0]),
            ("c", "positive", "youtube", 3, [0.0, 1.0]), ("c", "positive", "youtube", 4, [5.0, 5.0]),
            ("d", "negative", "reddit", 9, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "company string, sentiment string, source string, id long, "
                                     "embedding array<float>")
    hits = nearest(df, spark.createDataFrame([("t", [1.0, 0.0])], "topic string, vec array<double>"), k=3)
    got = sorted((r.company, r.rank, r.id) for r in hits.collect())
    assert got == [("c", 1, 1), ("c", 2, 2), ("c", 3, 3), ("d", 1, 9)]
