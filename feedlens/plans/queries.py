"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each one reads the driver's tables (through the derived review view) and runs
a library operator over all of it. Oracles with the same names and columns
live in ``oracles.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions.text import clean_text
from feedlens.operators import datasets as DS
from feedlens.operators import evaluate as EV
from feedlens.operators import ingest as IN
from feedlens.operators import metrics as M
from feedlens.operators import ngrams as NG
from feedlens.operators import retrieval as RT
from feedlens.operators import scoring as SC
from feedlens.operators import warehouse as WH
from feedlens.operators.sentiment_model import SentimentModel
from feedlens.sources import documents as DC
from feedlens.sources import files as FS
from feedlens.sources import pages as PG
from feedlens.sources.tables import reviews, scored, table
from feedlens.streaming import days as DY
from feedlens.streaming import highwater as HW
from feedlens.streaming import pipeline as SP

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-02-10"  # A5 reference day (the service uses current_date())


def _scored(spark, sf):
    return scored(spark, sf)


_STORED: dict[tuple[str, str], str] = {}  # (application, input) -> its warehouse


def _warehouse(spark, sf):
    """The four tables, written once for an application and input, and read back."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        path = FS.scratch_path(spark, "warehouse")
        prefix = "feedlens_" + path.rsplit("-", 1)[1]
        WH.store_warehouse(SC.score_reviews(reviews(spark, sf)), path, prefix)
        _STORED[key] = prefix
    return WH.stored_warehouse(spark, _STORED[key])


def _null_canonical(spark, sf):
    """Canonical reviews of which every seventh has no text and every thirteenth no company."""
    return IN.canonicalize(spark.read.schema(IN.WIRE_SCHEMA).parquet(_null_wire(spark, sf)))


def _faulty_warehouse(spark, sf):
    """The tables with faults made from their own rows: ids that repeat, orphans, missing values."""
    t = _warehouse(spark, sf)
    k = F.col("id").cast("bigint")
    p = t["predictions"]
    gone = (k % 11 == 0) & F.col("source").isin("youtube", "reddit")
    p = (p.filter(~gone).unionByName(p.filter(k % 7 == 0))
         .withColumn("company", F.when(k % 13 != 0, F.col("company"))).withColumn("source", F.when(k % 17 != 0, F.col("source")))
         .withColumn("id", F.when(k % 19 != 0, F.col("id"))))
    return t | {"predictions": p, "reddit": t["reddit"].unionByName(t["reddit"].filter(k % 5 == 0))}


QUERIES: dict[str, Query] = {
    # metrics
    "daily_by_source": lambda s, d: M.daily_by_source(_scored(s, d)),
    "daily_pivot": lambda s, d: M.daily_pivot(_scored(s, d)),
    "daily_overall": lambda s, d: M.daily_overall(_scored(s, d)),
    "daily_series_long": lambda s, d: M.daily_series_long(_scored(s, d)),
    "mean_of_daily": lambda s, d: M.mean_of_daily(_scored(s, d)),
    "avg_sentiment": lambda s, d: M.avg_sentiment(_scored(s, d)),
    "interactions_30d": lambda s, d: M.interactions_30d(_scored(s, d), AS_OF),
    "companies": lambda s, d: M.companies(_scored(s, d)),
    "volume_by_topic": lambda s, d: M.volume_by_topic(_wire(s, d).select("company")),
    "stars_matrix": lambda s, d: M.stars_matrix(_scored(s, d)),
    "avg_stars": lambda s, d: M.avg_stars(_scored(s, d)),
    "subreddit_matrix": lambda s, d: M.subreddit_matrix(_scored(s, d)),
    "avg_vote": lambda s, d: M.avg_vote(_scored(s, d)),
    "reddit_points": lambda s, d: M.reddit_points(_scored(s, d)),
    "youtube_engagement": lambda s, d: M.youtube_engagement(_scored(s, d)),
    "last_comment": lambda s, d: M.last_comment(_scored(s, d)),
    # scoring
    "stars_sentiment": lambda s, d: SC.stars_sentiment_table(reviews(s, d)),
    "score_reviews": lambda s, d: SC.score_reviews(reviews(s, d)).select(
        "id", "source", "company", "sentiment", *WH.PROBS),
    "prob_columns": lambda s, d: SC.score_reviews(reviews(s, d)).select("id", *WH.PROBS),
    "softmax_label": lambda s, d: SC.softmax_table(reviews(s, d)),
    "threshold_label": lambda s, d: SC.threshold_labels(reviews(s, d)),
    "gated_sentiment": lambda s, d: SC.gated_labels(reviews(s, d)),
    # warehouse
    "wh_predictions": lambda s, d: _warehouse(s, d)["predictions"],
    "wh_trustpilot": lambda s, d: _warehouse(s, d)["trustpilot"],
    "wh_youtube": lambda s, d: _warehouse(s, d)["youtube"],
    "wh_reddit": lambda s, d: _warehouse(s, d)["reddit"],
    "reddit_detail": lambda s, d: WH.detail(_warehouse(s, d), "reddit"),
    "youtube_detail": lambda s, d: WH.detail(_warehouse(s, d), "youtube"),
    "trustpilot_detail": lambda s, d: WH.detail(_warehouse(s, d), "trustpilot"),
    "pk_violations": lambda s, d: WH.pk_violations(_faulty_warehouse(s, d)),
    "fk_violations": lambda s, d: WH.fk_violations(_faulty_warehouse(s, d)),
    "canonical_nulls": lambda s, d: WH.canonical_nulls(_null_canonical(s, d)),
    "null_violations": lambda s, d: WH.null_violations(_faulty_warehouse(s, d)),
}


def _grams(spark, sf, ns=None, most=None):
    return NG.ngram_counts(reviews(spark, sf).select("company", "text"), ns=ns, most=most)


def _merged(spark, sf):
    r = reviews(spark, sf).select("company", "text", "date")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    first = NG.ngram_counts(r.filter(F.col("date") < cut))
    second = NG.ngram_counts(r.filter(F.col("date") >= cut))
    return NG.merge_counts(first, second)


QUERIES.update({
    "clean_text": lambda s, d: reviews(s, d).select("id", clean_text(F.col("text")).alias("clean_text")),
    "ngrams_all": _grams,
    "word_counts": lambda s, d: NG.counts_of(_grams(s, d, (1,)), 1),
    "bigram_counts": lambda s, d: NG.counts_of(_grams(s, d, (2,)), 2),
    "trigram_counts": lambda s, d: NG.counts_of(_grams(s, d, (3,)), 3),
    "ngram_merge": _merged,
    "ngram_top100": lambda s, d: NG.top_k(_grams(s, d, most=100), 100),
    "ngram_map": lambda s, d: NG.map_digest(NG.to_maps(NG.top_k(_grams(s, d, most=100), 100).drop("rank"))),
    "ngram_unpack": lambda s, d: NG.from_maps(NG.to_maps(NG.top_k(_grams(s, d, most=100), 100).drop("rank"))),
    "word_cloud": lambda s, d: NG.counts_of(_grams(s, d, (1,)), 1),
    "top_words": lambda s, d: NG.top_n_report(_grams(s, d, (1,), 20), 1, 20),
    "top_bigrams": lambda s, d: NG.top_n_report(_grams(s, d, (2,), 20), 2, 20),
    "top_trigrams": lambda s, d: NG.top_n_report(_grams(s, d, (3,), 20), 3, 20),
    "top_word": lambda s, d: NG.top_word(_grams(s, d, most=1)),
})


# --- datasets and evaluation -------------------------------------------------------------

CUT = "2024-01-15"  # boundary between the "earlier crawl" and the new batch


def _labelled(spark, sf):
    return DS.drop_unknown(_scored(spark, sf).select("id", "company", "source", "sentiment", "date", "stars"))


def _split(spark, sf):
    return DS.stratified_split(_labelled(spark, sf).select("id", "company", "sentiment"))


def _before(df, cut=CUT):
    return df.filter(F.col("date") < F.lit(cut).cast("timestamp_ntz"))


def _after(df, cut=CUT):
    return df.filter(F.col("date") >= F.lit(cut).cast("timestamp_ntz"))


def _videos(spark, sf):
    yt = _scored(spark, sf).filter(F.col("source") == "youtube")
    return yt.groupBy("company", F.col("videoid").alias("item")).agg(
        F.count(F.lit(1)).alias("n_comments"), F.min("date").alias("item_order"))


def _eval_input(spark, sf):
    return scored(spark, sf, with_gold=True).select("source", "logit_neg", "logit_neu", "logit_pos",
                                     F.col("gold_label").alias("gold"), F.col("sentiment").alias("pred"))


QUERIES.update({
    "stratified_split": _split,
    "balanced_set": lambda s, d: DS.split_balanced(_labelled(s, d).select("id", "company", "sentiment")),
    "quota_sample": lambda s, d: DS.quota_sample(
        _scored(s, d).filter(F.col("source") == "trustpilot").select("id", "company", "stars", "date"), 3),
    "train_set": lambda s, d: DS.train_set(
        _scored(s, d).filter(F.col("source") == "trustpilot"),
        _scored(s, d).filter(F.col("source") == "youtube")),
    "cap_per_item": lambda s, d: DS.cap_per_item(
        _scored(s, d).filter(F.col("source") == "youtube").select("id", "company", "videoid", "date"),
        "videoid", 3),
    "cap_oldest": lambda s, d: DS.cap_per_item(
        _scored(s, d).filter(F.col("source") == "reddit").select("id", "company", "subreddit", "date"),
        "subreddit", 5),
    "newest_unseen": lambda s, d: DS.newest_unseen(
        _scored(s, d).filter(F.col("source") == "reddit").select("id", "company", "date"),
        _before(_scored(s, d).filter(F.col("source") == "reddit"), "2024-01-10"), 10),
    "unseen_items": lambda s, d: DS.unseen_items(
        _after(_scored(s, d).filter(F.col("source") == "youtube")).select("company", "videoid").distinct(),
        _before(_scored(s, d).filter(F.col("source") == "youtube")), ["company", "videoid"]),
    "company_budget": lambda s, d: DS.company_budget(_videos(s, d), 10),
    "class_counts": lambda s, d: DS.class_counts(_scored(s, d)),
    "eval_global": lambda s, d: EV.global_metrics(_eval_input(s, d)),
    "eval_by_label": lambda s, d: EV.label_metrics(_eval_input(s, d)),
    "eval_by_source": lambda s, d: EV.global_metrics(_eval_input(s, d), ["source"]),
    "eval_loss": lambda s, d: EV.eval_loss(_eval_input(s, d)),
    "eval_long": lambda s, d: EV.metrics_long(_eval_input(s, d)),
})


# --- ingest ----------------------------------------------------------------------------------

RAW_DATE_FORMS = 6


def _raw_dates(spark, sf):
    """Review dates rendered in the shapes producers send (ISO Z, fraction, offset, space, date, junk)."""
    r = reviews(spark, sf).select("id", "date")
    k = F.col("id").cast("bigint") % RAW_DATE_FORMS
    shifted = F.col("date") + F.expr("INTERVAL 2 HOURS")
    raw = (F.when(k == 0, F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
           .when(k == 1, F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
           .when(k == 2, F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
           .when(k == 3, F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
           .when(k == 4, F.date_format("date", "yyyy-MM-dd"))
           .otherwise(F.concat(F.lit("n/a "), F.col("id"))))
    return r.select("id", raw.alias("raw"))


def _wire(spark, sf):
    return IN.wire_rows(reviews(spark, sf))


def _by_source(wire):
    yt = wire.filter(F.col("source") == "youtube").select(
        "source", "text", "date", "company", "videoid", "like_count", "youtube_reply_count")
    tp = wire.filter(F.col("source") == "trustpilot").select(
        "date", "stars", "text", F.col("location").alias("tp_location"), "source", "company")
    rd = wire.filter(F.col("source") == "reddit").select(
        "source", "text", "date", "company", "subreddit", "vote", "reddit_reply_count")
    return yt, tp, rd


def _video_items(spark, sf):
    yt = reviews(spark, sf).filter(F.col("source") == "youtube")
    return yt.groupBy("company", F.col("videoid").alias("item")).agg(
        F.concat(F.lit("PT"), (F.sum("like_count") % 9).cast("string"), F.lit("M"),
                 ((F.count(F.lit(1)) * 7) % 60).cast("string"), F.lit("S")).alias("duration"),
        F.count(F.lit(1)).alias("comment_count"),
        (F.sum("like_count") * 50).cast("bigint").alias("view_count"))


def _durations(spark, sf):
    yt = reviews(spark, sf).filter(F.col("source") == "youtube")
    k = F.col("id").cast("bigint") % 6
    h, m, s = F.col("youtube_reply_count") % 3, F.col("like_count") % 60, F.col("like_count") % 47
    raw = (F.when(k == 0, F.format_string("PT%dH%dM%dS", h, m, s))
           .when(k == 1, F.format_string("PT%dM", m))
           .when(k == 2, F.lit("PT")).when(k == 3, F.lit("0"))
           .when(k == 4, F.format_string("P1DT%dH", h)).otherwise(F.lit("")))
    return yt.select("id", raw.alias("duration")).withColumn("seconds", IN.duration_seconds(F.col("duration")))


def _highwater(spark, sf):
    r = reviews(spark, sf).select("company", "date")
    return _before(r).groupBy("company").agg(F.max("date").alias("highwater"))


def _messages(spark, sf):
    return IN.encode_payload(_wire(spark, sf))


def _mixed_messages(spark, sf):
    """Good messages and, for every review whose text has an odd length, one that holds the bare text."""
    junk = reviews(spark, sf).filter(F.char_length("text") % 2 == 1).select(
        F.col("company").alias("topic"), F.concat(F.lit("no parquet: "), "text").cast("binary").alias("payload"))
    return _messages(spark, sf).select("topic", "payload").unionByName(junk)


QUERIES.update({
    "normalize_dates": lambda s, d: _raw_dates(s, d).withColumn("parsed", IN.parse_date(F.col("raw"))),
    "review_id": lambda s, d: _wire(s, d).select(
        "company", "source", IN.review_id(*IN.CANONICAL).alias("review_id")),
    "canonical_reviews": lambda s, d: IN.canonicalize(*_by_source(_wire(s, d))),
    "dedup_reviews": lambda s, d: IN.dedup_reviews(reviews(s, d)),
    "nested_comments": lambda s, d: IN.nested_comments(
        IN.comment_payloads(_wire(s, d).filter(F.col("source") == "youtube"))),
    "eligibility": lambda s, d: IN.eligibility(
        _video_items(s, d), IN.company_config(reviews(s, d).select("company").distinct())),
    "duration_seconds": _durations,
    "since_highwater": lambda s, d: IN.since_highwater(
        reviews(s, d).select("id", "company", "date"), _highwater(s, d)),
    "highwater_update": lambda s, d: IN.highwater_update(
        _highwater(s, d), _after(reviews(s, d).select("company", "date"))),
    "encode_payload": lambda s, d: _messages(s, d).groupBy("topic").agg(
        F.sum("n_rows").cast("bigint").alias("n_rows"), (F.max("n_rows") <= 100).alias("within_limit")),
    "decode_payload": lambda s, d: IN.split_dead_letters(IN.decode_payload(_messages(s, d)))[0].drop("topic", "row"),
    "dead_letter": lambda s, d: IN.split_dead_letters(IN.decode_payload(_mixed_messages(s, d)))[1]
        .select("topic", F.col("payload").cast("string").alias("payload")),
})


# --- retrieval -------------------------------------------------------------------------------


def _vec_items(spark, sf, rows=None):
    rows = _scored(spark, sf) if rows is None else rows
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.join(rows.select("id", *RT.GROUP), F.col("id") == F.col("vec_id").cast("string")).select(
        *RT.GROUP, F.col("vec_id").alias("id"), "embedding")


def _topics(spark, sf):
    return RT.centroids(table(spark, sf, "embeddings"))


def _hits(spark, sf, rows=None, topics=None):
    return RT.nearest(_vec_items(spark, sf, rows), _topics(spark, sf) if topics is None else topics, RT.K)


def _contexts(spark, sf, rows=None, topics=None):
    rows = _scored(spark, sf) if rows is None else rows
    texts = RT.chunks(rows.select("id", "text")).select(F.col("id").cast("bigint").alias("id"), "chunk")
    return RT.topic_context(_hits(spark, sf, rows, topics), texts)


def _answers(spark, sf, rows=None):
    rows = _scored(spark, sf) if rows is None else rows
    topics = _topics(spark, sf)
    return RT.answers(rows.select("company").distinct(), _contexts(spark, sf, rows, topics), topics)


def _text_vectors(spark, sf):
    """(chunks with their vectors, the weights of words over all chunks)."""
    rows = RT.chunks(_scored(spark, sf).select("id", *RT.GROUP, "text"))
    weights = RT.word_weights(rows)
    return RT.embed_text(rows.select("id", *RT.GROUP, "chunk"), weights), weights


def _text_hits(spark, sf):
    vecs, weights = _text_vectors(spark, sf)
    named = spark.createDataFrame([(t, t) for t in RT.TOPICS], "id string, chunk string")
    topics = RT.embed_text(named, weights).select(F.col("id").alias("topic"), F.col("embedding").alias("vec"))
    return RT.nearest(vecs, topics, RT.K), vecs, topics


def _text_answers(spark, sf):
    hits, vecs, topics = _text_hits(spark, sf)
    return RT.answers(vecs.select("company").distinct(), RT.topic_context(hits, vecs), topics)


QUERIES.update({
    "first_chunk": lambda s, d: RT.chunks(_scored(s, d).select("id", "text")).select("id", "chunk"),
    "reviews_in_range": lambda s, d: RT.reviews_in_range(
        _scored(s, d), "negative", "youtube", "2024-01-05", "2024-01-20").select("id", "company", "date"),
    "retrieve_topk": _hits,
    "topic_context": _contexts,
    "answers": _answers,
    "answers_upsert": lambda s, d: RT.answers_upsert(
        _answers(s, d, _before(_scored(s, d))),
        # the new half has no review of the companies that end in 1, 2 or 3: their old answers stay
        _answers(s, d, _after(_scored(s, d)).filter(~F.col("company").rlike("[123]$")))),
    "answers_read": lambda s, d: RT.flatten_answers(RT.answers_read(RT.nest_answers(_answers(s, d)), "src0")),
    "embed_text": lambda s, d: _text_vectors(s, d)[0].select("id", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0")
    .select("id", "dim", F.round("value", 9).alias("value")),
    "text_topk": lambda s, d: _text_hits(s, d)[0].select("company", "sentiment", "source", "id", "topic", "rank", "dist"),
    "retrieve_text": _text_answers,
})


# --- sources and sinks -----------------------------------------------------------------------


def _keyed_rows(spark, sf):
    s = _scored(spark, sf).filter(F.col("source") == "youtube")
    topic = F.when(F.col("sentiment") == "neutral", "other-comments").otherwise("product-feedback")
    return s.select("id", "company", "text", "date", "videoid", topic.alias("topic"), "sentiment")


def _mixed_documents(spark, sf):
    """Documents of three kinds, some of them broken: cut off, or valid JSON of another shape."""
    r = IN.wire_rows(reviews(spark, sf), extra=("id",))
    k = F.col("id").cast("bigint")
    r = r.withColumn("_broken", (k % 9).isin(0, 1)).withColumn("_cut", k % 9 == 0)
    yt, tp, rd = (r.filter(F.col("source") == x) for x in ("youtube", "trustpilot", "reddit"))
    shape = F.concat(F.lit('["'), "id", F.lit('"]'))
    bad = lambda rows, start: rows.filter("_broken").select("company", F.when(F.col("_cut"), F.concat(F.lit(start), "text")).otherwise(shape).alias("d"))
    comments = IN.comment_payloads(yt.filter("NOT _broken")).unionByName(bad(yt, '{"items": [').withColumnRenamed("d", "payload"))
    page = F.floor(k / 300)
    pages = PG.review_pages(tp.filter("NOT _broken"), page).unionByName(
        bad(tp, '{"props": ').select("company", F.concat(F.lit("<html><script>"), "d", F.lit("</script></html>")).alias("html")))
    keyed = FS.keyed_documents(rd.filter("NOT _broken").withColumn("topic", F.lit("t")).withColumn("sentiment", F.lit("s")), page).select(
        F.lit(None).cast("string").alias("company"), "doc").unionByName(bad(rd, '{"a": [{"text": ').withColumnRenamed("d", "doc"))
    return comments, pages, keyed


def _document_rejects(spark, sf):
    comments, pages, keyed = _mixed_documents(spark, sf)
    parts = [("comments", DC.split_documents(comments, "payload", "comments")[1]),
             ("page", DC.split_documents(pages.select("company", PG.last_script("html").alias("script")), "script", "page")[1]),
             ("keyed", DC.split_documents(keyed, "doc", "keyed")[1])]
    out = [df.select(F.lit(kind).alias("kind"), "company", "reason", "document") for kind, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _readable_documents(spark, sf):
    """Rows of the documents that can be read, from the same mixed input."""
    comments, pages, keyed = _mixed_documents(spark, sf)
    rows = IN.nested_comments(DC.split_documents(comments, "payload", "comments")[0]).select("company", "text", "date")
    good = DC.split_documents(pages.withColumn("script", PG.last_script("html")), "script", "page")[0]
    return (rows.unionByName(PG.page_json_reviews(good).select("company", "text", "date"))
            .unionByName(FS.flatten_keyed(DC.split_documents(keyed, "doc", "keyed")[0]).select("company", "text", "date")))


def _json_roundtrip(spark, sf):
    df = DS.train_set(_scored(spark, sf).filter(F.col("source") == "trustpilot"),
                      _scored(spark, sf).filter(F.col("source") == "youtube"))
    path = FS.write_json(df, FS.scratch_path(spark, "json"))
    return FS.read_json(spark, path, df.schema)


def _train_rows(spark, sf):
    return DS.train_set(_scored(spark, sf).filter(F.col("source") == "trustpilot"),
                        _scored(spark, sf).filter(F.col("source") == "youtube"))


def _json_write(spark, sf):
    df = _train_rows(spark, sf)
    # The older half first, then the newer one (and a batch of none) appended to it
    first = F.col("id").cast("bigint") % 2 == 0
    path = FS.write_json(df.filter(first), FS.scratch_path(spark, "jsonl"))
    FS.write_json(df.filter(~first), path)
    FS.write_json(df.filter(F.lit(False)), path)
    return spark.read.schema(df.schema).json(path)


def _json_read(spark, sf):
    df = _train_rows(spark, sf)
    path = FS.write_json_arrays(df, FS.scratch_path(spark, "jsonarr"))
    return FS.read_json(spark, path, df.schema, array_of_records=True)


def _doc_store(spark, sf):
    path = FS.write_doc_store(_scored(spark, sf), FS.scratch_path(spark, "docs"))
    return FS.read_doc_store(spark, path).select("company", "source", "date", "text", "sentiment")


def _paged(spark, sf):
    """Trustpilot wire rows with the page they stand on: those of a company and of 300 neighbouring ids."""
    rows = reviews(spark, sf).filter(F.col("source") == "trustpilot")
    return IN.wire_rows(rows, extra=("id",)).withColumn("page", F.floor(F.col("id").cast("bigint") / 300))


QUERIES.update({
    "document_rejects": _document_rejects,
    "readable_documents": _readable_documents,
    "page_title_text": lambda s, d: PG.page_title_text(table(s, d, "pages")),
    "page_json_reviews": lambda s, d: PG.page_json_reviews(PG.review_pages(_paged(s, d), F.col("page"))),
    "review_blocks": lambda s, d: PG.review_blocks(PG.block_pages(_paged(s, d), F.col("page"), F.pmod(F.xxhash64("id"), F.lit(4)))),
    "nested_submissions": lambda s, d: IN.nested_submissions(IN.submission_payloads(
        reviews(s, d).filter(F.col("source") == "reddit"), F.floor(F.col("id").cast("bigint") / 300))),
    "flatten_keyed": lambda s, d: FS.flatten_keyed(FS.keyed_documents(_keyed_rows(s, d), F.floor(F.col("id").cast("bigint") / 300))),
    "json_roundtrip": _json_roundtrip,
    "json_write": _json_write,
    "json_read": _json_read,
    "doc_store": _doc_store,
    "geo_points": lambda s, d: FS.geo_points(s, _scored(s, d).filter(F.col("source") == "trustpilot")),
    "synth_reviews": lambda s, d: FS.synth_reviews(
        reviews(s, d).groupBy("company").agg(F.count(F.lit(1)).alias("n"))),
})


# --- streaming -------------------------------------------------------------------------------


#: Rows in a file of a landing, bytes of a micro-batch at least, and micro-batches that take a landing at most, about.
LANDED_ROWS, BATCH_BYTES, BATCHES = 5_000, 8 << 20, 16


def _land(wire, path):
    """A landing of many files, whatever the tables' files are: micro-batches are made of whole files."""
    wire.write.option("compression", "zstd").option("maxRecordsPerFile", LANDED_ROWS).parquet(path)
    return path


def _landing(spark, sf):
    return _land(_wire(spark, sf), FS.scratch_path(spark, "landing"))


def _undated_landing(spark, sf):
    """Wire rows in which every fifth review has a date that no producer's format fits."""
    path = FS.scratch_path(spark, "undated")
    r = reviews(spark, sf)
    wire = IN.wire_rows(r, extra=("id",))
    bad = F.col("id").cast("bigint") % 5 == 0
    return _land(wire.withColumn("date", F.when(bad, F.concat(F.lit("some time on "), "date")).otherwise(F.col("date"))).drop("id"), path)


def _model(spark, sf):
    """The sentiment model of the loop, fitted on the training set."""
    return SentimentModel.fitted(spark, _train_rows(spark, sf), FS.scratch_path(spark, "model"))


def _model_sentiment(spark, sf):
    r = reviews(spark, sf)
    out = SC.score_reviews(r.select([c for c in r.columns if not c.startswith("logit_")]), _model(spark, sf))
    return out.select("id", "source", "company", "sentiment", *WH.PROBS)


def _run_stream(spark, sf, landing=_landing):
    base, model, path = FS.scratch_path(spark, "stream"), _model(spark, sf), landing(spark, sf)
    model.copies = 1  # a large model is dealt out for every micro-batch, which is small beside it
    fs, p = DY._folder(spark, path)
    size = max(BATCH_BYTES, fs.getContentSummary(p).getLength() // BATCHES)
    _, state = SP.run_ingest(spark, SP.file_source(spark, path, bytes_per_trigger=size, consume=True), f"{base}/out", f"{base}/checkpoint", model)
    return base, state


def _stream_predictions(spark, sf):
    """Predictions of the loop with their probabilities and documents, as the sinks hold them."""
    base, _ = _run_stream(spark, sf)
    out = {n: spark.read.parquet(f"{base}/out/warehouse/{n}") for n in ("predictions", "youtube", "reddit")}
    probs = out["youtube"].select("id", *WH.PROBS).unionByName(out["reddit"].select("id", *WH.PROBS))
    return out["predictions"].join(probs, "id", "left").select("id", "source", "company", "date", "sentiment", *WH.PROBS)


def _stream_rejects(spark, sf):
    base, _ = _run_stream(spark, sf, _undated_landing)
    return spark.read.parquet(f"{base}/out/rejects").select("id", "source", "company", "date", "text")


def _stream_daily(spark, sf):
    base = FS.scratch_path(spark, "daily")
    SP.daily_stream(spark, SP.file_source(spark, _landing(spark, sf)), f"{base}/out", f"{base}/checkpoint", _model(spark, sf))
    return SP.read_daily(spark, f"{base}/out", by_source=True)


def _highwater_pass(spark, sf):
    """A pass over the reviews, shuffled over many files, a third of them sent twice; the marks are those of the earlier crawl."""
    base = FS.scratch_path(spark, "highwater")
    _highwater(spark, sf).write.parquet(f"{base}/marks/pass=0")
    r = reviews(spark, sf).select("id", "company", "date")
    again = r.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == 0)
    r.unionByName(again).repartition(6, F.xxhash64("id", "date")).write.parquet(f"{base}/landing/a")
    again.repartition(2).write.parquet(f"{base}/landing/b")
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", True).parquet(f"{base}/landing")
    HW.run_pass(spark, stream, base, 1)
    return base


def _late_days(spark, sf):
    """Three landings: the first half, the second half, and every tenth review, late."""
    base = FS.scratch_path(spark, "days")
    wire = IN.wire_rows(reviews(spark, sf), extra=("id", ))
    late, first = F.col("id").cast("bigint") % 10 == 0, IN.parse_date(F.col("date")) < F.lit(CUT).cast("timestamp_ntz")
    for part in (~late & first, ~late & ~first, late):
        wire.filter(part).drop("id").write.mode("append").parquet(f"{base}/landing")
        DY.day_stream(spark, SP.file_source(spark, f"{base}/landing"), f"{base}/out", f"{base}/checkpoint", _cached_model(spark, sf, base))
    return DY.read_days(spark, f"{base}/out")


def _cached_model(spark, sf, base):
    """The model of a run: fitted once, then read."""
    path = f"{base}/model"
    fs, p = DY._folder(spark, path)
    return SentimentModel.stored(spark, path) if fs.exists(p) else SentimentModel.fitted(spark, _train_rows(spark, sf), path)


def _null_wire(spark, sf):
    """Wire rows in which every seventh review has no text and every thirteenth no company."""
    path = FS.scratch_path(spark, "nulls")
    k = F.col("id").cast("bigint")
    wire = IN.wire_rows(reviews(spark, sf), extra=("id",))
    wire = wire.withColumn("text", F.when(k % 7 != 0, F.col("text"))).withColumn("company", F.when(k % 13 != 0, F.col("company")))
    return _land(wire.drop("id"), path)


QUERIES.update({
    "stream_volume": lambda s, d: SP.stream_volume(s, f"{_run_stream(s, d)[0]}/out"),
    "stream_nulls": lambda s, d: SP.stream_nulls(s, f"{_run_stream(s, d, _null_wire)[0]}/out"),
    "stream_closed_days": lambda s, d: _late_days(s, d).select("company", "source", "day", "part", "s", "n_rows"),
    "stream_since_highwater": lambda s, d: HW.passed(s, _highwater_pass(s, d), 1),
    "stream_older_rows": lambda s, d: HW.older(s, _highwater_pass(s, d), 1),
    "stream_highwater_marks": lambda s, d: HW.marks(s, _highwater_pass(s, d)),
    "sentiment_model": lambda s, d: _model(s, d).table,
    "model_sentiment": _model_sentiment,
    "stream_ingest": _stream_predictions,
    "ngram_state": lambda s, d: _run_stream(s, d)[1].read(),
    "stream_daily": _stream_daily,
    "stream_rejects": _stream_rejects,
})
