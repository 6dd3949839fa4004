"""Tables on the way are removed, row keys are the rows' own, and the first stage decides by row."""

import os

from pyspark.sql import functions as F

from feedlens.llm import common, exact_dedup, jaccard_join, quality, windows
from feedlens.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def folders(spark):
    path = checkpoint_dir(spark) + "/feedlens-llm"
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_only_the_decision_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, keep in (("gone", exact_dedup.keep_last), ("gone", jaccard_join.keep_first), ("cuts", windows.without_repeats)):
        before = folders(spark)
        out = keep(spark, docs)
        assert [f.split("-")[0] for f in folders(spark) - before] == [name]
        assert out.count() > 0


def test_scratch_goes_when_the_block_fails(spark):
    before = folders(spark)
    try:
        with common.scratch(spark):
            common.written(spark, spark.range(5), "lost")
            with common.scratch(spark):
                kept = common.written(spark, spark.range(7), "inner", stays=True)
            assert kept.count() == 7
            raise KeyError
    except KeyError:
        pass
    assert folders(spark) == before


def test_row_keys(spark, make):
    rows, key = common.numbered(spark, make([(5, "a"), (3, "b")]))
    assert {(r.doc_id, r[key]) for r in rows.collect()} == {(5, 5), (3, 3)}
    clash = make([(3, "a"), (None, "b"), (3, "c"), (-1, "d")]).withColumn("__row", F.lit(1))
    rows, key = common.numbered(spark, clash)
    got = sorted((r[key], r.doc_id) for r in rows.collect())
    assert key != "__row" and len({k for k, _ in got}) == 4 and [i for _, i in got] == [-1, 3, 3, None]


def test_internal_names_may_be_columns(spark, make):
    rows = [(1, "one text here"), (2, "One text here"), (3, "another")]
    df = make(rows)
    for name in ("__row", "__gone", "__doc", "__cuts", "__row_"):
        df = df.withColumn(name, F.lit("x"))
    for keep, left in ((exact_dedup.keep_last, 2), (jaccard_join.keep_first, 2), (windows.without_repeats, 3)):
        out = keep(spark, df)
        assert out.columns == df.columns and out.count() == left


def test_quality_stage_drops_rows_not_ids(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r.predicted for r in quality.score(spark, docs, labels).collect()}
    bad, good = (min(i for i, p in scored.items() if p == k) for k in (0, 1))
    fresh = (docs.where(F.col("doc_id").isin(bad, good)).withColumn("was", F.col("doc_id")))
    odd = fresh.withColumn("doc_id", F.lit(10**9).cast("long")).unionByName(fresh.withColumn("doc_id", F.lit(None).cast("long")))
    out = quality.keep_good(spark, docs.withColumn("was", F.lit(None).cast("long")).unionByName(odd), labels)
    assert sorted(str((r.doc_id, r.was)) for r in out.where("was IS NOT NULL").collect()) == sorted(str(x) for x in ((10**9, good), (None, good)))
    assert {r.doc_id for r in out.where("was IS NULL").select("doc_id").collect()} == {i for i, p in scored.items() if p}


def test_workers_remember_few_words_and_find_windows_in_small_batches():
    """What a task's worker holds besides its batch stays small: executors run one for each core."""
    from feedlens.llm import windows
    from feedlens.llm.common import WORD_HASHES, word_hashes

    for start in range(0, 300_000, 50_000):
        word_hashes(" ".join(f"w{i}" for i in range(start, start + 50_000)))
        assert len(WORD_HASHES) <= 100_000
    assert windows.TOKENS <= 150_000
