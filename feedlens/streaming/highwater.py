"""P15/I4 as a stream: rows at or after their company's high-water mark pass, older ones are counted.

A pass is one run of the query over what there is. It starts from the marks that earlier
passes left (a small versioned table), holds them as keyed state, and only when it has ended it
leaves the new marks: the newest date of each company. So a late row is never lost to a mark
that moved while the pass ran, and the order of arrival does not matter.

The state's key is the company and a hash part of the row id, so a company with a third of all rows
is ``parts`` keys; a company's mark is given to each of them as initial state. Rows that come twice are
taken out by their id before (streaming state too, RocksDB). Every micro-batch writes its own folder, so a replayed
one replaces itself; marks of a pass are written under the pass's number.

Edge cases: a company without a mark passes whole; rows without a date or company
pass neither as new nor as older: they are in the counted output under NULL; an empty pass leaves the marks as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedlens.operators.ingest import highwater_update

PARTS = 64
ROWS = "id string, company string, date timestamp_ntz"
OUT = "id string, company string, micros long, n_older long"


class HighWater(StatefulProcessor):
    """State of a (company, part): the mark, and how many older rows came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._mark = handle.getValueState("mark", "micros long")
        self._older = handle.getValueState("older", "n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._mark.update((int(initialState["mark"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        mark = self._mark.get()[0] if self._mark.exists() else None
        older = 0
        for batch in rows:
            passes = batch["micros"].notna() & batch["company"].notna()
            if mark is not None:
                passes &= batch["micros"] >= mark
            older += int((~passes).sum())
            new = batch[passes]
            if len(new):
                yield pd.DataFrame({"id": new["id"], "company": new["company"], "micros": new["micros"], "n_older": 0})
        if older:
            self._older.update(((self._older.get()[0] if self._older.exists() else 0) + older,))
            yield pd.DataFrame({"id": [None], "company": [key[0]], "micros": [None], "n_older": [older]}).astype(
                {"micros": "Int64", "n_older": "int64"})

    def close(self) -> None:
        pass


def _micros(date: str):
    return F.unix_micros(F.col(date).cast("timestamp"))


def marks(spark: SparkSession, base: str) -> DataFrame:
    """(company, highwater) as the last finished pass left them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/marks")  # type: ignore[attr-defined]
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # type: ignore[attr-defined]
    done = [s.getPath() for s in (fs.listStatus(path) if fs.exists(path) else []) if fs.exists(s.getPath().suffix("/_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], "company string, highwater timestamp_ntz")
    return spark.read.parquet(max(done, key=lambda p: int(p.getName().partition("=")[2])).toString())


def run_pass(spark: SparkSession, source: DataFrame, base: str, number: int, parts: int = PARTS) -> None:
    """One pass over ``source`` (a stream of id, company, date); run again with the same ``number`` it goes on where it stopped.

    Leaves ``base``/rows and ``base``/older (a folder a micro-batch) and the marks of pass ``number``.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    before = marks(spark, base)
    initial = before.filter("company IS NOT NULL AND highwater IS NOT NULL").select(
        "company", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), _micros("highwater").alias("mark"))
    rows = source.select("id", "company", _micros("date").alias("micros"), part.alias("part")).dropDuplicates(["id"])
    out = rows.groupBy("company", "part").transformWithStateInPandas(
        statefulProcessor=HighWater(), outputStructType=OUT, outputMode="Append", timeMode="None", initialState=initial.groupBy("company", "part"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        folder = f"pass={number}/batch_id={batch_id}"
        batch = batch.persist()
        try:
            new = batch.filter("n_older = 0").select("id", "company", F.timestamp_micros("micros").cast("timestamp_ntz").alias("date"))
            new.write.mode("overwrite").parquet(f"{base}/rows/{folder}")
            batch.filter("n_older > 0").groupBy("company").agg(F.sum("n_older").alias("n_older")).write.mode("overwrite").parquet(f"{base}/older/{folder}")
        finally:
            batch.unpersist()

    q = (out.writeStream.option("checkpointLocation", f"{base}/checkpoint/pass={number}").foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    seen = passed(spark, base, number)
    after = before if seen is None else highwater_update(before, seen.select("company", "date"))
    after.write.mode("overwrite").parquet(f"{base}/marks/pass={number}")


def passed(spark: SparkSession, base: str, number: int) -> DataFrame | None:
    """Rows that a pass let through; None when it had no input."""
    return _read(spark, f"{base}/rows/pass={number}", ROWS)


def older(spark: SparkSession, base: str, number: int) -> DataFrame | None:
    """(company, n_older): how many rows a pass held back."""
    found = _read(spark, f"{base}/older/pass={number}", "company string, n_older long")
    return None if found is None else found.groupBy("company").agg(F.sum("n_older").alias("n_older"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[attr-defined]
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)  # type: ignore[attr-defined]
    # The folders' batch numbers are no columns of the result.
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path) if there else None
