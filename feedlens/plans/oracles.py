"""Independent DuckDB SQL for each registered query (same names, same columns)."""

from __future__ import annotations

from feedlens.functions.text import STOP_WORDS  # a fixed word list; every rule below is written out here
from feedlens.plans.fixture_sql import with_fixture as W

A1 = ("CASE WHEN sentiment = 'positive' THEN 1 WHEN sentiment = 'negative' THEN -1 "
      "WHEN sentiment = 'neutral' THEN 0 END")
A4 = "CASE WHEN sentiment = 'positive' THEN 1 WHEN sentiment = 'neutral' THEN 0 ELSE -1 END"
SOFTMAX_CTE = """
sm AS (
  SELECT *, greatest(logit_neg, logit_neu, logit_pos) AS mx FROM reviews
), sm2 AS (
  SELECT *, exp(logit_neg - mx) AS e0, exp(logit_neu - mx) AS e1, exp(logit_pos - mx) AS e2 FROM sm
), probs AS (
  SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM sm2
), sc AS (
  SELECT *, CASE WHEN source = 'trustpilot' THEN NULL ELSE round(p0, 6) END AS negative_probability,
    CASE WHEN source = 'trustpilot' THEN NULL ELSE round(p1, 6) END AS neutral_probability,
    CASE WHEN source = 'trustpilot' THEN NULL ELSE round(p2, 6) END AS positive_probability,
    CASE WHEN source = 'trustpilot' THEN
      CASE WHEN stars > 3 THEN 'positive' WHEN stars = 3 THEN 'neutral' ELSE 'negative' END
    ELSE CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'negative' WHEN p1 >= p2 THEN 'neutral' ELSE 'positive' END
    END AS sentiment2
  FROM probs
), predictions AS (
  SELECT id, source, date, company, sentiment2 AS sentiment FROM sc
), wh_trustpilot AS (
  SELECT id, stars, location FROM sc WHERE source = 'trustpilot'
), wh_youtube AS (
  SELECT id, videoid, like_count, youtube_reply_count,
    CAST(negative_probability AS FLOAT) AS negative_probability,
    CAST(neutral_probability AS FLOAT) AS neutral_probability,
    CAST(positive_probability AS FLOAT) AS positive_probability
  FROM sc WHERE source = 'youtube'
), wh_reddit AS (
  SELECT id, subreddit, vote, reddit_reply_count,
    CAST(negative_probability AS FLOAT) AS negative_probability,
    CAST(neutral_probability AS FLOAT) AS neutral_probability,
    CAST(positive_probability AS FLOAT) AS positive_probability
  FROM sc WHERE source = 'reddit'
)"""

FAULTY_CTE = SOFTMAX_CTE.strip().rstrip(",") + """,
pk AS (SELECT *, CAST(id AS BIGINT) AS k FROM predictions),
kept AS (SELECT * FROM pk WHERE NOT (k % 11 = 0 AND source IN ('youtube', 'reddit'))
         UNION ALL SELECT * FROM pk WHERE k % 7 = 0),
bad_predictions AS (SELECT CASE WHEN k % 19 <> 0 THEN id END AS id, CASE WHEN k % 17 <> 0 THEN source END AS source, date,
    CASE WHEN k % 13 <> 0 THEN company END AS company, sentiment FROM kept),
bad_reddit AS (SELECT * FROM wh_reddit UNION ALL SELECT * FROM wh_reddit WHERE CAST(id AS BIGINT) % 5 = 0)"""
TS_CTE = """
ts0 AS (SELECT id, exp(logit_pos) AS a0, exp(logit_neu) AS a1, exp(logit_neg) AS a2,
          exp(logit_neg) AS b0, exp(logit_neu) AS b1, exp(logit_pos) AS b2 FROM reviews),
ts AS (SELECT id, a0 / (a0 + a1 + a2) AS t0, a1 / (a0 + a1 + a2) AS t1, a2 / (a0 + a1 + a2) AS t2,
          b0 / (b0 + b1 + b2) AS s0, b1 / (b0 + b1 + b2) AS s1, b2 / (b0 + b1 + b2) AS s2 FROM ts0)"""

SENTS = "(VALUES ('negative'), ('neutral'), ('positive')) AS s(sentiment)"


def _pivot_cols(expr: str) -> str:
    return ", ".join(f"round(avg(CASE WHEN lower(source) = '{x}' THEN {expr} END), 6) AS {x}"
                     for x in ("reddit", "trustpilot", "youtube"))


ORACLES: dict[str, str] = {
    "daily_by_source": W(f"""
SELECT company, CAST(date AS DATE) AS day, lower(source) AS source,
  round(avg({A1}), 6) AS daily_sentiment_score
FROM scored GROUP BY 1, 2, 3"""),
    "daily_pivot": W(f"""
SELECT company, CAST(date AS DATE) AS day, {_pivot_cols(A1)}
FROM scored GROUP BY 1, 2 ORDER BY 1, 2"""),
    "daily_overall": W(f"""
SELECT company, CAST(date AS DATE) AS day, round(avg({A1}), 6) AS score
FROM scored GROUP BY 1, 2 ORDER BY 1, 2"""),
    "daily_series_long": W(f"""
SELECT company, day, series, score FROM w
UNPIVOT (score FOR series IN (main, reddit, trustpilot, youtube))
WHERE score IS NOT NULL""", ctes=f"""
w AS (SELECT company, CAST(date AS DATE) AS day, round(avg({A1}), 6) AS main, {_pivot_cols(A1)}
      FROM scored GROUP BY 1, 2)"""),
    "mean_of_daily": W(f"""
SELECT company, series, round(avg(coalesce(score, 0)), 6) AS mean_score FROM (
  SELECT company, day, series, score FROM w
  UNPIVOT (score FOR series IN (main, reddit, trustpilot, youtube)) WHERE score IS NOT NULL)
GROUP BY 1, 2""", ctes=f"""
w AS (SELECT company, CAST(date AS DATE) AS day, round(avg({A1}), 6) AS main, {_pivot_cols(A1)}
      FROM scored GROUP BY 1, 2)"""),
    "avg_sentiment": W(f"""
SELECT company, source, round(avg({A4}), 6) AS avg_sentiment
FROM scored GROUP BY GROUPING SETS ((company), (company, source))"""),
    "interactions_30d": W("""
SELECT company, CAST(date AS DATE) AS day, count(*) AS daily_count
FROM scored WHERE CAST(date AS DATE) >= DATE '2024-02-10' - 30 GROUP BY 1, 2"""),
    "companies": W("SELECT DISTINCT company FROM scored"),
    "volume_by_topic": W("""
SELECT company AS topic, count(*) AS n_rows, count(*) > 0 AS has_data FROM reviews GROUP BY 1"""),
    "stars_matrix": W(f"""
SELECT c.company, st.stars, s.sentiment, coalesce(k.n, 0) AS n_reviews
FROM (SELECT DISTINCT company FROM scored) c
CROSS JOIN (SELECT CAST(x AS INT) AS stars FROM range(1, 6) t(x)) st
CROSS JOIN {SENTS}
LEFT JOIN (SELECT company, stars, sentiment, count(*) AS n FROM scored
           WHERE source = 'trustpilot' GROUP BY 1, 2, 3) k
  ON k.company = c.company AND k.stars = st.stars AND k.sentiment = s.sentiment"""),
    "avg_stars": W("""
SELECT company, round(avg(coalesce(stars, 0)), 6) AS avg_stars
FROM scored WHERE source = 'trustpilot' GROUP BY 1"""),
    "subreddit_matrix": W(f"""
SELECT c.company, c.subreddit, s.sentiment, coalesce(k.n, 0) AS n_reviews
FROM (SELECT DISTINCT company, subreddit FROM scored WHERE source = 'reddit') c
CROSS JOIN {SENTS}
LEFT JOIN (SELECT company, subreddit, sentiment, count(*) AS n FROM scored
           WHERE source = 'reddit' GROUP BY 1, 2, 3) k
  ON k.company = c.company AND k.subreddit IS NOT DISTINCT FROM c.subreddit AND k.sentiment = s.sentiment"""),
    "avg_vote": W("""
SELECT company, round(avg(coalesce(vote, 0)), 6) AS avg_vote
FROM scored WHERE source = 'reddit' GROUP BY 1"""),
    "reddit_points": W("""
SELECT company, id, sentiment, coalesce(vote, 0) AS score, coalesce(reddit_reply_count, 0) AS replies
FROM scored WHERE source = 'reddit'"""),
    "youtube_engagement": W(f"""
SELECT c.company, s.sentiment, round(coalesce(k.l, 0), 6) AS avg_likes,
  round(coalesce(k.r, 0), 6) AS avg_replies, round(c.o, 6) AS overall_avg_likes
FROM (SELECT company, avg(coalesce(like_count, 0)) AS o FROM scored WHERE source = 'youtube' GROUP BY 1) c
CROSS JOIN {SENTS}
LEFT JOIN (SELECT company, sentiment, avg(coalesce(like_count, 0)) AS l,
             avg(coalesce(youtube_reply_count, 0)) AS r
           FROM scored WHERE source = 'youtube' GROUP BY 1, 2) k
  ON k.company = c.company AND k.sentiment = s.sentiment"""),
    "last_comment": W("""
SELECT company,
  arg_max(text, {'d': date, 'i': id}) FILTER (WHERE lower(source) = 'reddit') AS reddit,
  arg_max(text, {'d': date, 'i': id}) FILTER (WHERE lower(source) = 'trustpilot') AS trustpilot,
  arg_max(text, {'d': date, 'i': id}) FILTER (WHERE lower(source) = 'youtube') AS youtube
FROM scored GROUP BY 1"""),
    # scoring
    "stars_sentiment": W("""
SELECT id, stars, CASE WHEN stars > 3 THEN 'positive' WHEN stars = 3 THEN 'neutral' ELSE 'negative' END
  AS sentiment FROM reviews WHERE source = 'trustpilot'"""),
    "score_reviews": W("""
SELECT id, source, company, sentiment2 AS sentiment, negative_probability, neutral_probability,
  positive_probability FROM sc""", ctes=SOFTMAX_CTE),
    "prob_columns": W("""
SELECT id, negative_probability, neutral_probability, positive_probability FROM sc""", ctes=SOFTMAX_CTE),
    "softmax_label": W("""
SELECT id, round(p0, 6) AS negative_probability, round(p1, 6) AS neutral_probability,
  round(p2, 6) AS positive_probability,
  CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'negative' WHEN p1 >= p2 THEN 'neutral' ELSE 'positive' END
  AS sentiment FROM probs""", ctes=SOFTMAX_CTE),
    "threshold_label": W("""
SELECT id,
  CASE WHEN greatest(t0, t1, t2) > 0.45 THEN
    CASE WHEN t0 >= t1 AND t0 >= t2 THEN 'product-feedback' WHEN t1 >= t2 THEN 'video-feedback'
         ELSE 'other-comments' END ELSE 'unknown' END AS topic,
  CASE WHEN greatest(s0, s1, s2) > 0 THEN
    CASE WHEN s2 >= s1 AND s2 >= s0 THEN 'positive' WHEN s1 >= s0 THEN 'neutral' ELSE 'negative' END
    ELSE 'unknown' END AS sentiment
FROM ts""", ctes=TS_CTE),
    "gated_sentiment": W("""
SELECT id, topic, CASE WHEN topic = 'unknown' THEN 'unknown'
  WHEN topic IN ('other-comments', 'video-feedback') THEN 'neutral' ELSE sentiment END AS sentiment
FROM (SELECT id,
  CASE WHEN greatest(t0, t1, t2) > 0.45 THEN
    CASE WHEN t0 >= t1 AND t0 >= t2 THEN 'product-feedback' WHEN t1 >= t2 THEN 'video-feedback'
         ELSE 'other-comments' END ELSE 'unknown' END AS topic,
  CASE WHEN greatest(s0, s1, s2) > 0 THEN
    CASE WHEN s2 >= s1 AND s2 >= s0 THEN 'positive' WHEN s1 >= s0 THEN 'neutral' ELSE 'negative' END
    ELSE 'unknown' END AS sentiment FROM ts)""", ctes=TS_CTE),
    # warehouse
    "wh_predictions": W("SELECT * FROM predictions", ctes=SOFTMAX_CTE),
    "wh_trustpilot": W("SELECT * FROM wh_trustpilot", ctes=SOFTMAX_CTE),
    "wh_youtube": W("SELECT * FROM wh_youtube", ctes=SOFTMAX_CTE),
    "wh_reddit": W("SELECT * FROM wh_reddit", ctes=SOFTMAX_CTE),
    "reddit_detail": W("""
SELECT r.*, p.company, p.date, p.sentiment FROM wh_reddit r JOIN predictions p ON p.id = r.id""",
                       ctes=SOFTMAX_CTE),
    "youtube_detail": W("""
SELECT r.*, p.company, p.date, p.sentiment FROM wh_youtube r JOIN predictions p ON p.id = r.id""",
                        ctes=SOFTMAX_CTE),
    "trustpilot_detail": W("""
SELECT r.*, p.company, p.date, p.sentiment FROM wh_trustpilot r JOIN predictions p ON p.id = r.id""",
                           ctes=SOFTMAX_CTE),
    "pk_violations": W("""
SELECT table_name, id, n_rows FROM (
  SELECT 'predictions' AS table_name, id, count(*) AS n_rows FROM bad_predictions GROUP BY id
  UNION ALL SELECT 'trustpilot', id, count(*) FROM wh_trustpilot GROUP BY id
  UNION ALL SELECT 'youtube', id, count(*) FROM wh_youtube GROUP BY id
  UNION ALL SELECT 'reddit', id, count(*) FROM bad_reddit GROUP BY id) WHERE n_rows > 1""", ctes=FAULTY_CTE),
    "fk_violations": W("""
SELECT 'trustpilot' AS table_name, id FROM wh_trustpilot t WHERE NOT EXISTS (SELECT 1 FROM bad_predictions p WHERE p.id = t.id)
UNION ALL SELECT 'youtube', id FROM wh_youtube t WHERE NOT EXISTS (SELECT 1 FROM bad_predictions p WHERE p.id = t.id)
UNION ALL SELECT 'reddit', id FROM bad_reddit t WHERE NOT EXISTS (SELECT 1 FROM bad_predictions p WHERE p.id = t.id)""", ctes=FAULTY_CTE),
    "null_violations": W("""
SELECT count(*) FILTER (WHERE id IS NULL) AS null_id, count(*) FILTER (WHERE source IS NULL) AS null_source,
  count(*) FILTER (WHERE company IS NULL) AS null_company FROM bad_predictions""", ctes=FAULTY_CTE),
}


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
# Word characters: letters, numbers, underscore; white space as Python's str.isspace has it.
CLEAN = (r"lower(replace(regexp_replace(regexp_replace(coalesce(text, ''), "
         r"'[^_\p{L}\p{N}\p{Z}\x09-\x0D\x1C-\x1F\x{85}]', '', 'g'), '\p{Nd}', '', 'g'), chr(10), ' '))")
GRAMS_CTE = f"""
cl AS (SELECT company, date, string_split({CLEAN}, ' ') AS w FROM reviews),
g AS (
  SELECT company, date, 1 AS n, unnest(list_filter(w, lambda x: x <> '' AND x NOT IN ({_STOP}))) AS gram FROM cl
  UNION ALL
  SELECT company, date, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
  FROM cl WHERE len(w) >= 2
  UNION ALL
  SELECT company, date, 3, unnest(list_transform(range(1, len(w) - 1),
                                                 lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  FROM cl WHERE len(w) >= 3
),
gc AS (SELECT company, n, gram, count(*) AS count FROM g GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY company, n ORDER BY count DESC, gram ASC) AS rank FROM gc),
top100 AS (SELECT * FROM top WHERE rank <= 100)"""
NAMES = {1: "word", 2: "bigram", 3: "trigram"}


def _report(n: int) -> str:
    run = r"[_\p{L}\p{N}]+"
    keep = (r"regexp_matches(gram, '[^\p{Z}\x09-\x0D\x1C-\x1F\x{85}]')" if n == 1
            else f"regexp_full_match(gram, '{' '.join([run] * n)}')")
    return W(f"""SELECT company, gram AS {NAMES[n]}, count, rank FROM top
WHERE n = {n} AND rank <= 20 AND {keep}""", ctes=GRAMS_CTE)


ORACLES.update({
    "clean_text": W(f"SELECT id, {CLEAN} AS clean_text FROM reviews"),
    "ngrams_all": W("SELECT company, n, gram, count FROM gc", ctes=GRAMS_CTE),
    "word_counts": W("SELECT company, gram AS word, count FROM gc WHERE n = 1", ctes=GRAMS_CTE),
    "bigram_counts": W("SELECT company, gram AS bigram, count FROM gc WHERE n = 2", ctes=GRAMS_CTE),
    "trigram_counts": W("SELECT company, gram AS trigram, count FROM gc WHERE n = 3", ctes=GRAMS_CTE),
    "ngram_merge": W("SELECT company, n, gram, count FROM gc", ctes=GRAMS_CTE),
    "ngram_top100": W("SELECT company, n, gram, count, rank FROM top100", ctes=GRAMS_CTE),
    "ngram_map": W("""
SELECT company, n, count(*) AS n_entries, CAST(sum(count) AS BIGINT) AS total,
  sha256(array_to_string(list_sort(list(gram || '=' || CAST(count AS VARCHAR))), chr(10))) AS entries_sha
FROM top100 GROUP BY 1, 2""", ctes=GRAMS_CTE),
    "ngram_unpack": W("SELECT company, n, gram, count FROM top100", ctes=GRAMS_CTE),
    "word_cloud": W("SELECT company, gram AS word, count FROM gc WHERE n = 1", ctes=GRAMS_CTE),
    "top_words": _report(1),
    "top_bigrams": _report(2),
    "top_trigrams": _report(3),
    "top_word": W("""
SELECT company, n, arg_min(gram, {'c': -count, 'g': gram}) AS top_gram, max(count) AS top_count
FROM top100 GROUP BY 1, 2""", ctes=GRAMS_CTE),
})


# --- datasets and evaluation -------------------------------------------------------------
SPLIT_CTE = """
lab AS (SELECT id, company, sentiment FROM scored WHERE sentiment <> 'unknown'),
rk AS (SELECT *, row_number() OVER (PARTITION BY company, sentiment ORDER BY md5(id), id) AS r,
         count(*) OVER (PARTITION BY company, sentiment) AS n FROM lab),
split AS (SELECT id, company, sentiment, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split
          FROM rk),
train AS (SELECT id, company, sentiment FROM split WHERE split = 'train'),
per AS (SELECT company, sentiment, count(*) AS c FROM train GROUP BY 1, 2),
tgt AS (SELECT company, max(c) FILTER (WHERE sentiment <> 'neutral') AS target,
          max(c) FILTER (WHERE sentiment = 'neutral') AS cur FROM per GROUP BY 1),
neu AS (SELECT t.*, target, cur, row_number() OVER (PARTITION BY t.company ORDER BY md5(t.id), t.id) AS rk
        FROM train t JOIN tgt ON tgt.company = t.company WHERE sentiment = 'neutral')"""

CONF_CTE = """
ev AS (SELECT source, gold_label AS gold, sentiment AS pred, logit_neg, logit_neu, logit_pos
       FROM scored WHERE gold_label IS NOT NULL),
conf AS (SELECT source, gold, pred, count(*) AS n FROM ev GROUP BY 1, 2, 3),
lt AS (SELECT gold AS label, sum(n) AS true_sum, sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS tp
       FROM conf GROUP BY 1),
lp AS (SELECT pred AS label, sum(n) AS pred_sum FROM conf GROUP BY 1),
pl AS (SELECT coalesce(lt.label, lp.label) AS label, coalesce(tp, 0) AS tp, coalesce(true_sum, 0) AS true_sum,
         coalesce(pred_sum, 0) AS pred_sum FROM lt FULL OUTER JOIN lp ON lt.label = lp.label),
plm AS (SELECT *, CASE WHEN pred_sum > 0 THEN tp / pred_sum ELSE 0 END AS precision,
          CASE WHEN true_sum > 0 THEN tp / true_sum ELSE 0 END AS recall,
          CASE WHEN true_sum + pred_sum > 0 THEN 2 * tp / (true_sum + pred_sum) ELSE 0 END AS f1 FROM pl),
slt AS (SELECT source, gold AS label, sum(n) AS true_sum, sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS tp
        FROM conf GROUP BY 1, 2),
slp AS (SELECT source, pred AS label, sum(n) AS pred_sum FROM conf GROUP BY 1, 2),
spl AS (SELECT coalesce(slt.source, slp.source) AS source, coalesce(slt.label, slp.label) AS label,
          coalesce(tp, 0) AS tp, coalesce(true_sum, 0) AS true_sum, coalesce(pred_sum, 0) AS pred_sum
        FROM slt FULL OUTER JOIN slp ON slt.source = slp.source AND slt.label = slp.label),
splm AS (SELECT *, CASE WHEN pred_sum > 0 THEN tp / pred_sum ELSE 0 END AS precision,
           CASE WHEN true_sum > 0 THEN tp / true_sum ELSE 0 END AS recall,
           CASE WHEN true_sum + pred_sum > 0 THEN 2 * tp / (true_sum + pred_sum) ELSE 0 END AS f1 FROM spl),
g AS (SELECT 'global' AS scope, 'all' AS key, round(sum(tp) / sum(true_sum), 4) AS accuracy,
        round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM plm),
bl AS (SELECT 'label' AS scope, d.label AS key, round(coalesce(recall, 0), 4) AS accuracy,
         round(coalesce(precision, 0), 4) AS precision, round(coalesce(recall, 0), 4) AS recall,
         round(coalesce(f1, 0), 4) AS f1
       FROM (VALUES ('negative'), ('neutral'), ('positive')) d(label) LEFT JOIN plm ON plm.label = d.label),
bs AS (SELECT 'source' AS scope, source AS key, round(sum(tp) / sum(true_sum), 4) AS accuracy,
         round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1
       FROM splm GROUP BY source)"""

LOSS_CTE = """
lx AS (SELECT source, CASE source WHEN 'trustpilot' THEN 0.1 ELSE 0.2 END AS eps,
         CAST(CASE source WHEN 'trustpilot' THEN 1.0 ELSE 0.5 END AS DOUBLE) AS weight,
         CASE gold WHEN 'negative' THEN logit_neg WHEN 'neutral' THEN logit_neu ELSE logit_pos END AS xy,
         logit_neg, logit_neu, logit_pos,
         greatest(logit_neg, logit_neu, logit_pos) AS m FROM ev WHERE source IN ('trustpilot', 'youtube')),
ly AS (SELECT *, m + ln(exp(logit_neg - m) + exp(logit_neu - m) + exp(logit_pos - m)) AS lse FROM lx),
lz AS (SELECT source, weight, -(1 - eps) * (xy - lse)
         - eps / 3 * ((logit_neg - lse) + (logit_neu - lse) + (logit_pos - lse)) AS ce FROM ly),
per_src AS (SELECT source, avg(ce) AS loss, first(weight) AS weight FROM lz GROUP BY 1)"""

ORACLES.update({
    "stratified_split": W("SELECT id, company, sentiment, split FROM split", ctes=SPLIT_CTE),
    "balanced_set": W("""
SELECT id, company, sentiment, 1 AS copy FROM train WHERE sentiment <> 'neutral'
UNION ALL SELECT id, company, sentiment, 1 FROM neu WHERE target IS NULL
UNION ALL SELECT id, company, sentiment, 1 FROM neu WHERE target IS NOT NULL AND cur >= target AND rk <= target
UNION ALL SELECT id, company, sentiment, CAST(r.copy AS INT) FROM (
  SELECT *, CAST(floor(target / cur) + CASE WHEN rk <= target % cur THEN 1 ELSE 0 END AS BIGINT) AS reps
  FROM neu WHERE cur < target) x, range(1, x.reps + 1) r(copy)""", ctes=SPLIT_CTE),
    "quota_sample": W("""
SELECT id, company, stars, date, rank FROM (
  SELECT id, company, stars, date,
    row_number() OVER (PARTITION BY company, stars ORDER BY date DESC, id DESC) AS rank
  FROM scored WHERE source = 'trustpilot')
WHERE rank <= CASE WHEN stars = 3 THEN 6 ELSE 3 END"""),
    "train_set": W("""
SELECT id, text, sentiment, source, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1
  WHEN 'positive' THEN 2 END AS sentiment_encoded FROM (
  SELECT id, text, sentiment, 'trustpilot' AS source FROM scored
  WHERE source = 'trustpilot' AND (stars NOT IN (2, 4) OR stars IS NULL)
  UNION ALL SELECT id, text, sentiment, 'youtube' FROM scored WHERE source = 'youtube')"""),
    "cap_per_item": W("""
SELECT * FROM (SELECT id, company, videoid, date,
  row_number() OVER (PARTITION BY company, videoid ORDER BY date, id) AS rank
  FROM scored WHERE source = 'youtube') WHERE rank <= 3"""),
    "cap_oldest": W("""
SELECT * FROM (SELECT id, company, subreddit, date,
  row_number() OVER (PARTITION BY company, subreddit ORDER BY date, id) AS rank
  FROM scored WHERE source = 'reddit') WHERE rank <= 5"""),
    "newest_unseen": W("""
SELECT * FROM (SELECT id, company, date,
  row_number() OVER (PARTITION BY company ORDER BY date DESC, id DESC) AS rank
  FROM scored WHERE source = 'reddit' AND date >= TIMESTAMP '2024-01-10') WHERE rank <= 10"""),
    "unseen_items": W("""
SELECT DISTINCT company, videoid FROM scored a WHERE source = 'youtube' AND date >= TIMESTAMP '2024-01-15'
  AND NOT EXISTS (SELECT 1 FROM scored b WHERE b.source = 'youtube' AND b.date < TIMESTAMP '2024-01-15'
                  AND b.company = a.company AND b.videoid IS NOT DISTINCT FROM a.videoid)"""),
    "company_budget": W("""
SELECT * FROM (SELECT company, item, n_comments, item_order,
  CAST(coalesce(sum(n_comments) OVER (PARTITION BY company ORDER BY item_order, item
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_total
  FROM (SELECT company, videoid AS item, count(*) AS n_comments, min(date) AS item_order
        FROM scored WHERE source = 'youtube' GROUP BY 1, 2)) WHERE prior_total < 10"""),
    "class_counts": W("SELECT company, sentiment, count(*) AS n_rows FROM scored GROUP BY 1, 2"),
    "eval_global": W("SELECT accuracy, precision, recall, f1 FROM g", ctes=CONF_CTE),
    "eval_by_label": W("SELECT key AS label, accuracy, precision, recall, f1 FROM bl", ctes=CONF_CTE),
    "eval_by_source": W("SELECT key AS source, accuracy, precision, recall, f1 FROM bs", ctes=CONF_CTE),
    "eval_loss": W("""
SELECT source, round(loss, 4) AS loss, weight FROM per_src
UNION ALL SELECT 'total', round(sum(loss * weight), 4), NULL FROM per_src""", ctes=CONF_CTE + "," + LOSS_CTE),
    "eval_long": W("""
SELECT scope, key, metric, value FROM (SELECT * FROM g UNION ALL SELECT * FROM bl UNION ALL SELECT * FROM bs)
UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1))""", ctes=CONF_CTE),
})


# --- ingest ----------------------------------------------------------------------------------
DATE_RE = (r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?)?"
           r"(Z|[+-]\d{2}:\d{2})?$")
WIRE_DATE = ("CASE source WHEN 'youtube' THEN strftime(date, '%Y-%m-%dT%H:%M:%SZ') "
             "WHEN 'trustpilot' THEN strftime(date, '%Y-%m-%dT%H:%M:%S.%gZ') "
             "WHEN 'reddit' THEN strftime(date, '%Y-%m-%d %H:%M:%S') END")


def _parse(col: str) -> str:
    g = lambda i: f"regexp_extract({col}, '{DATE_RE}', {i})"
    frac = f"(CASE WHEN {g(7)} = '' THEN 0 ELSE CAST({g(7)} AS DOUBLE) / pow(10, length({g(7)})) END)"
    secs = f"(CAST(coalesce(nullif({g(6)}, ''), '0') AS DOUBLE) + {frac})"
    tz = g(8)
    off = (f"(CASE WHEN {tz} IN ('', 'Z') THEN 0 ELSE (CASE WHEN substr({tz}, 1, 1) = '-' THEN -1 ELSE 1 END)"
           f" * (CAST(substr({tz}, 2, 2) AS INT) * 60 + CAST(substr({tz}, 5, 2) AS INT)) END)")
    ts = (f"make_timestamp(CAST({g(1)} AS BIGINT), CAST({g(2)} AS BIGINT), CAST({g(3)} AS BIGINT), "
          f"CAST(coalesce(nullif({g(4)}, ''), '0') AS BIGINT), CAST(coalesce(nullif({g(5)}, ''), '0') AS BIGINT), "
          f"{secs})")
    return f"(CASE WHEN regexp_full_match({col}, '{DATE_RE}') THEN {ts} - to_minutes({off}) END)"


def _rid(*cols: str) -> str:
    one = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols]
    return f"sha256({' || '.join(one)})"


ALL_COLUMNS = ("source", "text", "company", "date", "stars", "location", "videoid", "like_count",
               "youtube_reply_count", "subreddit", "vote", "reddit_reply_count")


WIRE_CTE = f"""
wire AS (SELECT source, text, company, {WIRE_DATE} AS date, stars, location, videoid, like_count,
           youtube_reply_count, subreddit, vote, reddit_reply_count FROM reviews)"""
HW_CTE = """
hw AS (SELECT company, max(date) AS highwater FROM reviews WHERE date < TIMESTAMP '2024-01-15' GROUP BY 1)"""

ORACLES.update({
    "normalize_dates": W(f"""
SELECT id, raw, {_parse('raw')} AS parsed FROM (
  SELECT id, CASE CAST(id AS BIGINT) % 6
    WHEN 0 THEN strftime(date, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 1 THEN strftime(date, '%Y-%m-%dT%H:%M:%S.%gZ')
    WHEN 2 THEN strftime(date + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+02:00'
    WHEN 3 THEN strftime(date, '%Y-%m-%d %H:%M:%S')
    WHEN 4 THEN strftime(date, '%Y-%m-%d')
    ELSE 'n/a ' || id END AS raw FROM reviews)"""),
    "review_id": W(f"SELECT company, source, {_rid(*ALL_COLUMNS)} AS review_id FROM wire",
                   ctes=WIRE_CTE),
    "canonical_reviews": W(f"""
SELECT source, text, company, {_parse('date')} AS date, stars, location, videoid, like_count, youtube_reply_count,
  subreddit, vote, reddit_reply_count, {_rid(*ALL_COLUMNS)} AS id FROM wire""",
                           ctes=WIRE_CTE),
    "dedup_reviews": W(f"""
SELECT company, {_rid('company', 'text')} AS content_key, arg_min(id, {{'d': date, 'i': id}}) AS kept_id,
  count(*) AS n_copies FROM reviews GROUP BY 1, 2"""),
    "nested_comments": W("""
SELECT company, videoid, text, date, like_count, youtube_reply_count FROM wire WHERE source = 'youtube'""",
                         ctes=WIRE_CTE),
    "eligibility": W("""
SELECT company, item, duration_s, comment_count, view_count,
  CASE WHEN duration_s < 240 THEN 'too_short'
       WHEN comment_count < 10 OR view_count < 1000 THEN 'currently_irrelevant' ELSE 'accepted' END AS status
FROM (SELECT company, videoid AS item, CAST((sum(like_count) % 9) * 60 + (count(*) * 7) % 60 AS BIGINT) AS duration_s,
        count(*) AS comment_count, CAST(sum(like_count) * 50 AS BIGINT) AS view_count
      FROM reviews WHERE source = 'youtube' GROUP BY 1, 2)"""),
    "duration_seconds": W("""
SELECT id, duration, CAST(CASE k WHEN 0 THEN h * 3600 + m * 60 + s WHEN 1 THEN m * 60 ELSE 0 END AS BIGINT)
  AS seconds FROM (
  SELECT id, CAST(id AS BIGINT) % 6 AS k, youtube_reply_count % 3 AS h, like_count % 60 AS m,
    like_count % 47 AS s,
    CASE CAST(id AS BIGINT) % 6
      WHEN 0 THEN 'PT' || (youtube_reply_count % 3) || 'H' || (like_count % 60) || 'M' || (like_count % 47) || 'S'
      WHEN 1 THEN 'PT' || (like_count % 60) || 'M'
      WHEN 2 THEN 'PT' WHEN 3 THEN '0'
      WHEN 4 THEN 'P1DT' || (youtube_reply_count % 3) || 'H' ELSE '' END AS duration
  FROM reviews WHERE source = 'youtube')"""),
    "since_highwater": W("""
SELECT r.id, r.company, r.date FROM reviews r LEFT JOIN hw ON hw.company = r.company
WHERE hw.highwater IS NULL OR r.date >= hw.highwater""", ctes=HW_CTE),
    "highwater_update": W("""
SELECT coalesce(hw.company, b.company) AS company, greatest(hw.highwater, b.m) AS highwater
FROM hw FULL OUTER JOIN (SELECT company, max(date) AS m FROM reviews WHERE date >= TIMESTAMP '2024-01-15'
                         GROUP BY 1) b ON b.company = hw.company""", ctes=HW_CTE),
    "encode_payload": W("SELECT company AS topic, count(*) AS n_rows, true AS within_limit FROM reviews GROUP BY 1"),
    "decode_payload": W("SELECT * FROM wire", ctes=WIRE_CTE),
    "dead_letter": W("""SELECT company AS topic, 'no parquet: ' || text AS payload FROM reviews
WHERE length(text) % 2 = 1"""),
})


# --- retrieval -------------------------------------------------------------------------------
CHUNK = ("(CASE WHEN j = '' THEN NULL WHEN regexp_extract(j, '(?s)^(.{1,100})(?: |\\z)', 1) <> '' "
         "THEN regexp_extract(j, '(?s)^(.{1,100})(?: |\\z)', 1) ELSE split_part(j, ' ', 1) END)")


def _summary(contexts: str) -> str:
    """CTEs: ``summed`` = a table of contexts (company, sentiment, source, topic, context) with their summaries (sentences, words and scores as rows)."""
    words = f"list_filter(string_split({CLEAN.replace('coalesce(text', 'coalesce(s')}, ' '), lambda x: x <> '' AND x NOT IN ({_STOP}))"
    return f"""
sen AS (SELECT company, sentiment, source, topic, nth, trim(s, ' ') AS s FROM (
          SELECT *, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS nth FROM (
            SELECT *, regexp_extract_all(context, '[^.!?\\n]+[.!?]*') AS l FROM {contexts})) WHERE trim(s, ' ') <> ''),
wrd AS (SELECT *, {words} AS w FROM sen),
cnt AS (SELECT company, sentiment, source, topic, nth, word, count(*) AS c FROM (SELECT *, unnest(w) AS word FROM wrd) GROUP BY ALL),
tot AS (SELECT company, sentiment, source, topic, word, sum(c) AS t FROM cnt GROUP BY ALL),
sco AS (SELECT c.company, c.sentiment, c.source, c.topic, nth, sum(c * t) / sqrt(CAST(sum(c * c) AS DOUBLE)) AS score
        FROM cnt c JOIN tot USING (company, sentiment, source, topic, word) GROUP BY ALL),
rkd AS (SELECT w.*, row_number() OVER (PARTITION BY w.company, w.sentiment, w.source, w.topic ORDER BY coalesce(score, 0) DESC, w.nth) AS r
        FROM wrd w LEFT JOIN sco s USING (company, sentiment, source, topic, nth)),
nxt AS (SELECT b.company, b.sentiment, b.source, b.topic, arg_min(b.s, b.r) AS second
        FROM rkd a JOIN rkd b USING (company, sentiment, source, topic) WHERE a.r = 1 AND b.r > 1
          AND NOT coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(a.w || b.w)), 0), 0) >= 0.5 GROUP BY ALL),
summed AS (SELECT a.company, a.sentiment, a.source, a.topic, concat_ws(' ', a.s, n.second) AS context
           FROM rkd a LEFT JOIN nxt n USING (company, sentiment, source, topic) WHERE a.r = 1)"""


def _retr_cte(where: str = "") -> str:
    return f"""
rows AS (SELECT * FROM scored {where}),
ex AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
cent AS (SELECT label AS topic, i, avg(CAST(x AS DOUBLE)) AS m FROM ex GROUP BY 1, 2),
items AS (SELECT r.company, r.sentiment, r.source, e.vec_id AS id
          FROM embeddings e JOIN rows r ON r.id = CAST(e.vec_id AS VARCHAR)),
dist AS (SELECT it.company, it.sentiment, it.source, it.id, c.topic,
           sum((CAST(ex.x AS DOUBLE) - c.m) * (CAST(ex.x AS DOUBLE) - c.m)) AS dist
         FROM items it JOIN ex ON ex.vec_id = it.id JOIN cent c ON c.i = ex.i
         GROUP BY it.company, it.sentiment, it.source, it.id, c.topic),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, sentiment, source, topic
                                                     ORDER BY dist, id) AS rank FROM dist) WHERE rank <= 3),
ch AS (SELECT CAST(id AS BIGINT) AS id, {CHUNK} AS chunk FROM (
         SELECT id, array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), ' ') AS j
         FROM rows)),
ctx AS (SELECT h.company, h.sentiment, h.source, h.topic, string_agg(ch.chunk, chr(10) ORDER BY h.rank) AS context
        FROM hits h JOIN ch ON ch.id = h.id WHERE ch.chunk IS NOT NULL
        GROUP BY h.company, h.sentiment, h.source, h.topic),
{_summary('ctx').strip()},
grid AS (SELECT c.company, s.sentiment, src.source, t.topic
         FROM (SELECT DISTINCT company FROM rows) c
         CROSS JOIN (VALUES ('negative'), ('neutral'), ('positive')) s(sentiment)
         CROSS JOIN (VALUES ('reddit'), ('trustpilot'), ('youtube')) src(source)
         CROSS JOIN (SELECT DISTINCT topic FROM cent) t),
ans AS (SELECT g.company, g.sentiment, g.source, g.topic, coalesce(ctx.context, 'No reviews found') AS answer
        FROM grid g LEFT JOIN summed ctx ON ctx.company = g.company AND ctx.sentiment = g.sentiment
          AND ctx.source = g.source AND ctx.topic = g.topic)"""


# Text vectors: signed sums of word weights in whole ten-thousandths, by md5 of the word.
_TOKENS = f"list_filter(string_split({CLEAN.replace('coalesce(text', 'coalesce(chunk')}, ' '), lambda x: x <> '')"
TEXT_CTE = f"""
ch AS (SELECT * FROM (SELECT id, company, sentiment, source, {CHUNK} AS chunk FROM (
         SELECT *, array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), ' ') AS j
         FROM scored)) WHERE chunk IS NOT NULL),
idf AS (SELECT word, count(DISTINCT id) AS df FROM (SELECT id, unnest({_TOKENS}) AS word FROM ch) GROUP BY 1),
wgt AS (SELECT word, CAST(round(10000 * (1 + ln(CAST(1 + (SELECT count(*) FROM ch) AS DOUBLE) / (1 + df)))) AS BIGINT) AS weight FROM idf),
txt AS (SELECT id, chunk FROM ch UNION ALL SELECT t, t FROM (VALUES ('Customer service'), ('Product quality'), ('Price'), ('General')) v(t)),
tok AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest({_TOKENS}) AS word FROM txt) GROUP BY 1, 2),
dim AS (SELECT id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS dim,
          CAST(sum(CASE WHEN substr(md5(word), 9, 1) < '8' THEN 1 ELSE -1 END * n * coalesce(weight,
            CAST(round(10000 * (1 + ln(CAST(1 + (SELECT count(*) FROM ch) AS DOUBLE)))) AS BIGINT))) AS BIGINT) AS v
        FROM tok LEFT JOIN wgt USING (word) GROUP BY 1, 2),
nrm AS (SELECT id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS len FROM dim GROUP BY 1),
vec AS (SELECT t.id, [coalesce(list_sum([CASE WHEN d.dim = i THEN d.v / nullif(l.len, 0) END FOR d IN m]), 0) FOR i IN range(64)] AS e
        FROM (SELECT DISTINCT id FROM txt) t LEFT JOIN nrm l USING (id)
        LEFT JOIN (SELECT id, list({{'dim': dim, 'v': v}}) AS m FROM dim GROUP BY 1) d ON d.id = t.id),
near AS (SELECT c.company, c.sentiment, c.source, c.id, q.id AS topic,
           list_sum(list_transform(list_zip(a.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
         FROM ch c JOIN vec a ON a.id = c.id CROSS JOIN (SELECT * FROM vec WHERE id IN ('Customer service', 'Product quality', 'Price', 'General')) q),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, sentiment, source, topic ORDER BY dist, id) AS rank FROM near) WHERE rank <= 3),
ctx AS (SELECT h.company, h.sentiment, h.source, h.topic, string_agg(ch.chunk, chr(10) ORDER BY h.rank) AS context
        FROM hits h JOIN ch ON ch.id = h.id GROUP BY h.company, h.sentiment, h.source, h.topic),
{_summary('ctx').strip()},
grid AS (SELECT c.company, s.sentiment, src.source, t.topic FROM (SELECT DISTINCT company FROM ch) c
         CROSS JOIN (VALUES ('negative'), ('neutral'), ('positive')) s(sentiment)
         CROSS JOIN (VALUES ('reddit'), ('trustpilot'), ('youtube')) src(source)
         CROSS JOIN (VALUES ('Customer service'), ('Product quality'), ('Price'), ('General')) t(topic)),
ans AS (SELECT g.company, g.sentiment, g.source, g.topic, coalesce(x.context, 'No reviews found') AS answer
        FROM grid g LEFT JOIN summed x USING (company, sentiment, source, topic))"""


ORACLES.update({
    "first_chunk": W(f"""
SELECT id, chunk FROM (SELECT id, {CHUNK} AS chunk FROM (
  SELECT id, array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), ' ') AS j
  FROM scored)) WHERE chunk IS NOT NULL"""),
    "reviews_in_range": W("""
SELECT id, company, date FROM scored WHERE sentiment = 'negative' AND source = 'youtube'
  AND date >= TIMESTAMP '2024-01-05' AND date <= TIMESTAMP '2024-01-20'"""),
    "retrieve_topk": W("SELECT company, sentiment, source, id, topic, round(dist, 6) AS dist, rank FROM hits",
                       ctes=_retr_cte()),
    "topic_context": W("SELECT * FROM ctx", ctes=_retr_cte()),
    "answers": W("SELECT * FROM ans", ctes=_retr_cte()),
    "answers_upsert": W(f"""
SELECT * FROM (WITH {_retr_cte("WHERE date >= TIMESTAMP '2024-01-15' AND NOT regexp_matches(company, '[123]$')").strip()}
               SELECT * FROM ans)
UNION ALL
SELECT * FROM (WITH {_retr_cte("WHERE date < TIMESTAMP '2024-01-15'").strip()}
               SELECT * FROM ans) WHERE company NOT IN (
  SELECT company FROM scored WHERE date >= TIMESTAMP '2024-01-15' AND NOT regexp_matches(company, '[123]$'))"""),
    "answers_read": W("SELECT * FROM ans WHERE company = 'src0'", ctes=_retr_cte()),
    "embed_text": W("""
SELECT id, CAST(dim AS INT) AS dim, round(v / len, 9) AS value FROM dim JOIN nrm USING (id) WHERE v <> 0 AND id IN (SELECT id FROM ch)""", ctes=TEXT_CTE),
    "text_topk": W("SELECT company, sentiment, source, id, topic, rank, round(dist, 6) AS dist FROM hits", ctes=TEXT_CTE),
    "retrieve_text": W("SELECT * FROM ans", ctes=TEXT_CTE),
})


# --- sources and sinks -----------------------------------------------------------------------
def _html_text(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{ent}', '{ch}')"
    return t


ORACLES.update({
    "page_title_text": f"""
SELECT page_id, block, title, content, title || ' ' || content AS text FROM (
  SELECT page_id, block,
    coalesce({_html_text("nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')")}, 'No Title') AS title,
    coalesce({_html_text("p")}, 'No Content') AS content
  FROM (SELECT page_id, html, unnest(range(greatest(len(ps), 1))) AS block, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE [NULL] END) AS p
        FROM (SELECT page_id, html, regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1) AS ps FROM pages)))""",
    "review_blocks": W("""
SELECT company, CASE WHEN stars = 2 THEN 'No Title ' || text
    WHEN length(text) - length(replace(text, ' ', '')) >= 3 THEN text ELSE text || ' ' END AS text,
  stars, date, CASE WHEN stars > 3 THEN 'positive' WHEN stars < 3 THEN 'negative' ELSE 'neutral' END AS sentiment
FROM wire WHERE source = 'trustpilot' AND stars IS NOT NULL""", ctes=WIRE_CTE),
    "nested_submissions": W("""
SELECT 'reddit' AS source, CASE WHEN first THEN split_part(text, ' ', 1) || ': ' || substr(text, length(split_part(text, ' ', 1)) + 2) ELSE text END AS text,
  company, strftime(date, '%Y-%m-%dT%H:%M:%SZ') AS date, subreddit, vote, reddit_reply_count
FROM (SELECT *, row_number() OVER (PARTITION BY company, subreddit, CAST(id AS BIGINT) // 300 ORDER BY CAST(id AS BIGINT)) = 1 AS first
      FROM reviews WHERE source = 'reddit')"""),
    "page_json_reviews": W("""
SELECT date, stars, CASE WHEN length(text) - length(replace(text, ' ', '')) >= 3 THEN text ELSE text || ' ' END
  AS text, coalesce(location, 'N/A') AS tp_location, source, company FROM wire WHERE source = 'trustpilot'""",
                           ctes=WIRE_CTE),
    "flatten_keyed": W("""
SELECT company, text, CAST(date AS VARCHAR) AS date, videoid AS yt_videoid,
  CASE WHEN sentiment = 'neutral' THEN 'other-comments' ELSE 'product-feedback' END AS topic, sentiment
FROM scored WHERE source = 'youtube'"""),
    "json_roundtrip": W("""
SELECT id, text, sentiment, source, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1
  WHEN 'positive' THEN 2 END AS sentiment_encoded FROM (
  SELECT id, text, sentiment, 'trustpilot' AS source FROM scored
  WHERE source = 'trustpilot' AND (stars NOT IN (2, 4) OR stars IS NULL)
  UNION ALL SELECT id, text, sentiment, 'youtube' FROM scored WHERE source = 'youtube')"""),
    "doc_store": W("SELECT company, source, date, text, sentiment FROM scored"),
    "geo_points": W("""
SELECT s.id, s.company, s.sentiment, s.location, CAST(g.lon AS DOUBLE) AS lon, CAST(g.lat AS DOUBLE) AS lat
FROM scored s
JOIN (VALUES ('USA', -100.0, 40.0), ('Germany', 10.0, 51.0), ('France', 2.0, 46.0), ('UK', -3.0, 55.0),
             ('de', 10.0, 51.0), ('fr', 2.0, 46.0), ('en', -3.0, 55.0), ('es', -4.0, 40.0)) g(location, lon, lat)
  ON g.location = s.location WHERE s.source = 'trustpilot'"""),
})


# Naive Bayes: weights are log probabilities with one added to each count, in whole millionths.
_WORDS = f"list_filter(string_split({CLEAN}, ' '), lambda x: x <> '' AND x NOT IN ({_STOP}))"


def _log(count: str, of: str) -> str:
    return f"CAST(round(1000000 * ln(({count} + 1) / CAST({of} AS DOUBLE))) AS BIGINT)"


NB_CTE = f"""
nbt AS (SELECT text, sentiment FROM scored WHERE (source = 'trustpilot' AND (stars NOT IN (2, 4) OR stars IS NULL)) OR source = 'youtube'),
nbw AS (SELECT sentiment, unnest({_WORDS}) AS word FROM nbt),
nbc AS (SELECT word, count(*) FILTER (WHERE sentiment = 'negative') AS c0, count(*) FILTER (WHERE sentiment = 'neutral') AS c1,
          count(*) FILTER (WHERE sentiment = 'positive') AS c2 FROM nbw GROUP BY 1),
nbn AS (SELECT sum(c0) AS n0, sum(c1) AS n1, sum(c2) AS n2, count(*) AS v FROM nbc),
nbm AS (SELECT word, {_log('c0', '(n0 + v)')} AS negative, {_log('c1', '(n1 + v)')} AS neutral, {_log('c2', '(n2 + v)')} AS positive FROM nbc, nbn),
nbp AS (SELECT {_log("count(*) FILTER (WHERE sentiment = 'negative')", '(count(*) + 3)')} AS p0,
          {_log("count(*) FILTER (WHERE sentiment = 'neutral')", '(count(*) + 3)')} AS p1,
          {_log("count(*) FILTER (WHERE sentiment = 'positive')", '(count(*) + 3)')} AS p2 FROM nbt)"""


def _nb_scored(rows: str, key: str) -> str:
    """CTEs: ``cued`` = the rows of a table with the model's probabilities and label."""
    return f"""
nbu AS (SELECT {key} AS k, unnest({_WORDS}) AS word FROM {rows}),
nbs AS (SELECT k, sum(negative) AS s0, sum(neutral) AS s1, sum(positive) AS s2 FROM nbu JOIN nbm USING (word) GROUP BY 1),
cue AS (SELECT r.*, (coalesce(s0, 0) + p0) / 1000000.0::DOUBLE AS l0, (coalesce(s1, 0) + p1) / 1000000.0::DOUBLE AS l1,
          (coalesce(s2, 0) + p2) / 1000000.0::DOUBLE AS l2 FROM {rows} r LEFT JOIN nbs ON nbs.k = r.{key}, nbp),
cue2 AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS ea, exp(l1 - greatest(l0, l1, l2)) AS en, exp(l2 - greatest(l0, l1, l2)) AS eb FROM cue),
cue3 AS (SELECT *, ea / (ea + en + eb) AS q0, en / (ea + en + eb) AS q1, eb / (ea + en + eb) AS q2 FROM cue2),
cued AS (SELECT * EXCLUDE (l0, l1, l2, ea, en, eb, q0, q1, q2),
  CASE WHEN source <> 'trustpilot' THEN q0 END AS negative, CASE WHEN source <> 'trustpilot' THEN q1 END AS neutral,
  CASE WHEN source <> 'trustpilot' THEN q2 END AS positive,
  CASE WHEN source = 'trustpilot' THEN CASE WHEN stars > 3 THEN 'positive' WHEN stars = 3 THEN 'neutral' ELSE 'negative' END
    WHEN q0 >= q1 AND q0 >= q2 THEN 'negative' WHEN q1 >= q2 THEN 'neutral' ELSE 'positive' END AS sentiment FROM cue3)"""


CUE_CTE = WIRE_CTE.strip().replace("wire AS (SELECT ", "wire AS (SELECT id AS rid, ") + "," + NB_CTE + "," + _nb_scored("wire", "rid")

ORACLES.update({
    "sentiment_model": W("""
SELECT word, negative, neutral, positive FROM nbm UNION ALL SELECT NULL, p0, p1, p2 FROM nbp""", ctes=NB_CTE),
    "model_sentiment": W("""
SELECT rid AS id, source, company, sentiment, round(negative, 6) AS negative_probability, round(neutral, 6) AS neutral_probability,
  round(positive, 6) AS positive_probability FROM cued""", ctes=CUE_CTE),
})


# --- streaming -------------------------------------------------------------------------------
ORACLES.update({
    "stream_ingest": W(f"""
SELECT DISTINCT {_rid(*ALL_COLUMNS)} AS id, source, company, {_parse('date')} AS date, sentiment,
  CAST(round(negative, 6) AS FLOAT) AS negative_probability, CAST(round(neutral, 6) AS FLOAT) AS neutral_probability,
  CAST(round(positive, 6) AS FLOAT) AS positive_probability FROM cued""", ctes=CUE_CTE),
    "ngram_state": W("SELECT company, n, gram, count FROM gc", ctes=GRAMS_CTE),
    "stream_rejects": W(f"""
SELECT DISTINCT {_rid(*ALL_COLUMNS)} AS id, source, company, date, text FROM (
  SELECT * REPLACE ('some time on ' || date AS date) FROM wire_id WHERE CAST(rid AS BIGINT) % 5 = 0)""",
                        ctes=WIRE_CTE.replace("wire AS (SELECT ", "wire_id AS (SELECT id AS rid, ")),
    "stream_daily": W(f"""
SELECT company, source, CAST({_parse('date')} AS DATE) AS day, round(avg({A1}), 6) AS score, count(*) AS n_rows
FROM (SELECT DISTINCT {', '.join(ALL_COLUMNS)}, sentiment FROM cued) GROUP BY 1, 2, 3""", ctes=CUE_CTE),
})

_BROKEN_CTE = WIRE_CTE.replace("wire AS (SELECT ", "wire AS (SELECT CAST(id AS BIGINT) AS rid, ")
ORACLES["document_rejects"] = W("""
SELECT CASE source WHEN 'youtube' THEN 'comments' WHEN 'trustpilot' THEN 'page' ELSE 'keyed' END AS kind, company,
  CASE WHEN rid % 9 = 0 THEN 'malformed' WHEN source = 'youtube' THEN 'no $.items' WHEN source = 'trustpilot' THEN 'no $.props.pageProps.reviews' ELSE 'no $' END AS reason,
  CASE WHEN rid % 9 = 1 THEN '["' || rid || '"]' WHEN source = 'youtube' THEN '{"items": [' || text WHEN source = 'trustpilot' THEN '{"props": ' || text
       ELSE '{"a": [{"text": ' || text END AS document FROM wire WHERE rid % 9 IN (0, 1)""", ctes=_BROKEN_CTE)
ORACLES["readable_documents"] = W("""
SELECT company, CASE WHEN source = 'trustpilot' AND length(text) - length(replace(text, ' ', '')) < 3 THEN text || ' ' ELSE text END AS text, date
FROM wire WHERE rid % 9 NOT IN (0, 1)""", ctes=_BROKEN_CTE)
_PARSED = _parse("date")
ORACLES["stream_volume"] = W(f"""
SELECT company AS topic, count(*) AS n_rows, true AS has_data FROM (SELECT DISTINCT {', '.join(ALL_COLUMNS)} FROM wire) GROUP BY 1""", ctes=WIRE_CTE)
_NULL_COLUMNS = ", ".join({"text": "CASE WHEN rid % 7 <> 0 THEN text END AS text", "company": "CASE WHEN rid % 13 <> 0 THEN company END AS company"}.get(c, c) for c in ALL_COLUMNS)
ORACLES["stream_nulls"] = W(f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE source IS NULL) AS null_source, count(*) FILTER (WHERE company IS NULL) AS null_company,
  count(*) FILTER (WHERE text IS NULL) AS null_text
FROM (SELECT DISTINCT {_NULL_COLUMNS} FROM wire)""", ctes=WIRE_CTE.replace("wire AS (SELECT ", "wire AS (SELECT CAST(id AS BIGINT) AS rid, "))
ORACLES["canonical_nulls"] = W("""
SELECT 0::BIGINT AS null_source, count(*) FILTER (WHERE text IS NULL OR CAST(id AS BIGINT) % 7 = 0) AS null_text,
  count(*) FILTER (WHERE company IS NULL OR CAST(id AS BIGINT) % 13 = 0) AS null_company FROM reviews""")
# Landings 1 and 2 hold the rows whose id is no multiple of ten; the bound is two days before the newest row seen.
ORACLES["stream_closed_days"] = W(f"""
SELECT company, source, day, part, CAST(sum(v) AS BIGINT) AS s, count(*) AS n_rows FROM (
  SELECT company, source, CAST(d AS DATE) AS day, {A1} AS v,
    CASE WHEN landing = 3 AND CAST(d AS DATE) + INTERVAL 1 DAY <= b2 THEN 'correction'
         WHEN CAST(d AS DATE) + INTERVAL 1 DAY <= greatest(b2, b3) THEN 'closed' ELSE 'open' END AS part
  FROM (SELECT *, (SELECT max(d) - INTERVAL 2 DAY FROM landed WHERE landing < 3) AS b2, (SELECT max(d) - INTERVAL 2 DAY FROM landed) AS b3 FROM landed))
GROUP BY 1, 2, 3, 4""", ctes=CUE_CTE + f""",
landed AS (SELECT company, source, sentiment, d, min(landing) AS landing FROM (
  SELECT {', '.join(ALL_COLUMNS)}, sentiment, {_PARSED} AS d, CASE WHEN CAST(rid AS BIGINT) % 10 = 0 THEN 3 ELSE 1 END AS landing FROM cued)
  GROUP BY {', '.join(ALL_COLUMNS)}, sentiment, d)""")
ORACLES["stream_since_highwater"] = ORACLES["since_highwater"]
ORACLES["stream_highwater_marks"] = W("""
SELECT r.company, greatest(max(r.date), max(hw.highwater)) AS highwater FROM reviews r LEFT JOIN hw ON hw.company = r.company
WHERE hw.highwater IS NULL OR r.date >= hw.highwater GROUP BY 1""", ctes=HW_CTE)
ORACLES["stream_older_rows"] = W("""
SELECT r.company, count(*) AS n_older FROM reviews r JOIN hw ON hw.company = r.company WHERE r.date < hw.highwater GROUP BY 1""", ctes=HW_CTE)
ORACLES["json_write"] = ORACLES["json_roundtrip"]
ORACLES["json_read"] = ORACLES["json_roundtrip"]
