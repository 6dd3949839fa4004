"""P15/I4 as a stream: passes over late, repeated and odd rows."""

import datetime as dt

from pyspark.sql import functions as F

from feedlens.streaming import highwater as HW

SCHEMA = "id string, company string, date timestamp_ntz"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_passes_start_from_the_marks_of_earlier_ones(spark, tmp_path):
    base, landing = str(tmp_path / "hw"), str(tmp_path / "in")
    # the first pass: no marks yet, so all rows pass, whatever their order
    land(spark, landing, [(f"a{i}", "a", day(i % 7)) for i in range(30)] + [("b1", "b", day(3))])
    land(spark, landing, [("a0", "a", day(0)), ("a99", "a", day(1)), ("n", None, day(1)), ("d", "a", None)])
    HW.run_pass(spark, stream(spark, landing), base, 1, parts=4)
    assert sorted(r.id for r in HW.passed(spark, base, 1).collect()) == sorted([f"a{i}" for i in range(30)] + ["a99", "b1"])
    assert {r.company: r.n_older for r in HW.older(spark, base, 1).collect()} == {None: 1, "a": 1}
    assert {r.company: r.highwater for r in HW.marks(spark, base).collect()} == {"a": day(6), "b": day(3)}
    # the second: a newer row comes before older ones and one on the mark; c is new
    second = str(tmp_path / "in2")
    land(spark, second, [("a200", "a", day(9)), ("b2", "b", day(2))])
    land(spark, second, [("a201", "a", day(6)), ("a202", "a", day(7)), ("a203", "a", day(5)), ("c1", "c", day(0))])
    land(spark, second, [("a200", "a", day(9)), ("a203", "a", day(5))])
    HW.run_pass(spark, stream(spark, second), base, 2, parts=4)
    assert sorted(r.id for r in HW.passed(spark, base, 2).collect()) == ["a200", "a201", "a202", "c1"]
    assert {r.company: r.n_older for r in HW.older(spark, base, 2).collect()} == {"a": 1, "b": 1}
    want = {"a": day(9), "b": day(3), "c": day(0)}
    assert {r.company: r.highwater for r in HW.marks(spark, base).collect()} == want
    # the same pass again finds nothing new and leaves everything as it is
    HW.run_pass(spark, stream(spark, second), base, 2, parts=4)
    assert HW.passed(spark, base, 2).count() == 4
    assert {r.company: r.highwater for r in HW.marks(spark, base).collect()} == want


def test_a_hot_company_is_many_keys(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    parts = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(HW.PARTS)).alias("p")).count()
    assert parts.count() == HW.PARTS and parts.agg(F.max("count")).first()[0] < 2000 / HW.PARTS * 2
