"""The loop loses no row: every row that came in is a prediction, a reject, a dead letter or a row read twice."""

import io

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedlens.operators.ingest import WIRE_FIELDS
from feedlens.sources.files import scratch_path
from feedlens.streaming.pipeline import daily_stream, file_source, message_file_source, process_batch, read_daily, run_ingest
from feedlens.streaming.state import DeltaState


def row(text, date, video="v1", source="youtube", company="c", **more):
    base = {n: None for n, _ in WIRE_FIELDS} | {"source": source, "text": text, "company": company, "date": date, "videoid": video}
    return base | more


def wire(spark, rows):
    names = [n for n, _ in WIRE_FIELDS]
    schema = ", ".join(f"{n} {t}" for n, t in WIRE_FIELDS)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def blob(rows):
    buf = io.BytesIO()
    kinds = {"string": pa.string(), "int": pa.int32()}
    pq.write_table(pa.table({n: pa.array([r[n] for r in rows], kinds[t]) for n, t in WIRE_FIELDS}), buf)
    return buf.getvalue()


MONTHS = [f"2023-{m:02d}-01T00:00:00Z" for m in (12, 3, 7, 1, 11, 2)]


@pytest.mark.parametrize("dedup", ["state", "watermark", "history"])
def test_late_rows_rejects_and_twins(spark, dedup):
    base = scratch_path(spark, "rows")
    rows = [row("Great!", d) for d in MONTHS]  # newest first, then months late
    rows += [row("Great!", "2023-05-05", video="v1"), row("Great!", "2023-05-05", video="v2")]  # one day, two videos
    rows += [row("no day", "yesterday"), row("no day", None)]
    src = []
    for i, r in enumerate([*rows, rows[0]]):  # the last file is read a second time
        wire(spark, [r]).coalesce(1).write.parquet(f"{base}/landing/{i}")
        src.append(f"{base}/landing/{i}")
    stream = spark.readStream.schema(file_source(spark, src[0]).schema).option("maxFilesPerTrigger", 3).parquet(f"{base}/landing/*")
    run_ingest(spark, stream, f"{base}/out", f"{base}/ckpt", dedup=dedup)
    assert spark.read.parquet(f"{base}/out/warehouse/predictions").count() == 8
    rejects = spark.read.parquet(f"{base}/out/rejects").collect()
    assert sorted(str(r.date) for r in rejects) == ["None", "yesterday"] and all(r.text == "no day" for r in rejects)


def test_daily_sums_take_late_rows_of_all_sources(spark):
    base = scratch_path(spark, "daily-late")
    rows = [row("so bad", d, source=s) for d in MONTHS for s in ("youtube", "reddit")]
    rows += [row("x", d, source="trustpilot", stars=k) for d in MONTHS for k in (5, None)]
    for i, r in enumerate(rows):
        wire(spark, [r]).coalesce(1).write.parquet(f"{base}/landing/{i}")
    stream = spark.readStream.schema(wire(spark, rows).schema).option("maxFilesPerTrigger", 7).parquet(f"{base}/landing/*")
    daily_stream(spark, stream, f"{base}/out", f"{base}/ckpt")
    got = {(str(r.day), r.source): (r.score, r.n_rows) for r in read_daily(spark, f"{base}/out", by_source=True).collect()}
    want = {"youtube": (-1.0, 1), "reddit": (-1.0, 1), "trustpilot": (0.0, 2)}  # no stars count as negative
    assert got == {(d[:10], s): v for d in MONTHS for s, v in want.items()}
    assert all(r.n_rows == 4 for r in read_daily(spark, f"{base}/out").collect())


def test_each_corrupt_message_is_a_dead_letter_with_its_payload(spark):
    base = scratch_path(spark, "dead")
    same = row("Great!", "2024-01-01")
    msgs = [("c", 0, 1, b"bad one"), ("c", 0, 2, b"bad one"), ("c", 0, 3, b"bad two"), ("c", 0, 4, blob([same, same])), ("c", 1, 4, blob([same]))]
    df = spark.createDataFrame(msgs, "topic string, partition int, offset long, payload binary")
    df.write.parquet(f"{base}/landing")
    df.where("offset IN (2, 4)").write.mode("append").parquet(f"{base}/landing")  # read again: same positions
    run_ingest(spark, message_file_source(spark, f"{base}/landing", positions=True), f"{base}/out", f"{base}/ckpt")
    dead = spark.read.parquet(f"{base}/out/dead_letters").collect()
    assert sorted((r.topic, r.offset, bytes(r.payload)) for r in dead) == [("c", 1, b"bad one"), ("c", 2, b"bad one"), ("c", 3, b"bad two")]
    assert all(r.decode_error for r in dead)
    assert spark.read.parquet(f"{base}/out/warehouse/predictions").count() == 3


def test_without_positions_different_payloads_stay_apart(spark):
    base = scratch_path(spark, "dead2")
    spark.createDataFrame([("c", b"x"), ("c", b"y"), ("d", b"x")], "topic string, payload binary").write.parquet(f"{base}/landing")
    run_ingest(spark, message_file_source(spark, f"{base}/landing"), f"{base}/out", f"{base}/ckpt")
    assert spark.read.parquet(f"{base}/out/dead_letters").count() == 3


def test_replayed_compaction_and_dropped_deltas(spark):
    st = DeltaState(spark, scratch_path(spark, "compact"), ["company", "n", "gram"])
    for b in range(4):
        st.write_delta(spark.createDataFrame([("a", 1, "x", 1), ("a", 1, f"y{b}", 2)], st.schema), b)
    want = sorted(map(tuple, st.read().collect()))
    st.compact()
    assert st._committed("deltas") == [3]  # folded deltas are gone, the last stays for a replay
    st.write_delta(spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y3", 2)], st.schema), 3)
    st.compact()  # the same batch again
    assert sorted(map(tuple, st.read().collect())) == want
    st.write_delta(spark.createDataFrame([("a", 1, "x", 5)], st.schema), 4)
    st.compact()
    assert {r.gram: r["count"] for r in st.read().collect()}["x"] == 9


def test_batch_is_decoded_once(spark):
    """The decoder runs once for all sinks of a micro-batch."""
    base = scratch_path(spark, "once")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    batch = wire(spark, [row(f"t{i}", "2024-01-01") for i in range(50)])
    from feedlens.operators.ingest import canonicalize

    rows = canonicalize(batch, keep_raw=True)
    process_batch(rows.mapInArrow(count, rows.schema), 0, base, DeltaState(spark, f"{base}/state", ["company", "n", "gram"]))
    assert seen.value == 50


def test_tie_goes_to_the_first_candidate(spark):
    from feedlens.operators.scoring import gated_labels, threshold_labels

    df = spark.createDataFrame([("1", "c", "s", "t", 1.0, 1.0, 1.0, None), ("2", "c", "s", "t", 2.0, 0.0, 2.0, "done"), ("3", "c", "s", "t", 1.0, 1.0, 0.0, None)],
                               "id string, company string, source string, text string, logit_neg double, logit_neu double, logit_pos double, had string")
    assert {r.id: r.sentiment for r in threshold_labels(df, 0.0).collect()} == {"1": "positive", "2": "positive", "3": "neutral"}
    got = {r.id: r.sentiment for r in gated_labels(df, 0.0, existing="had").collect()}
    assert got["2"] == "done" and got["1"] == "positive"


def test_word_filters_at_line_ends_and_blanks(spark):
    from feedlens.functions.text import not_blank, well_formed

    rows = spark.createDataFrame([("word",), ("word\r",), ("foo\tbar",), (" ",), ("a b",), ("a b\r",)], "g string")
    got = {r.g: (r.w, r.one, r.two) for r in rows.select("g", not_blank(F.col("g")).alias("w"), well_formed(F.col("g"), 1).alias("one"),
                                                        well_formed(F.col("g"), 2).alias("two")).collect()}
    assert got == {"word": (True, True, False), "word\r": (True, False, False), "foo\tbar": (True, False, False),
                   " ": (False, False, False), "a b": (True, False, True), "a b\r": (True, False, False)}
