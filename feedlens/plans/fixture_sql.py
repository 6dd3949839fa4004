"""DuckDB text of the derived review view, used by the independent oracles.

The Spark side builds the same view with the DataFrame API
(``feedlens.sources.tables.reviews``); both follow FIXTURES.md §3.
"""

REVIEWS_SQL = """
reviews AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id,
    CASE d.doc_id % 3 WHEN 0 THEN 'trustpilot' WHEN 1 THEN 'youtube' ELSE 'reddit' END AS source,
    d.source AS company, d.text AS text,
    CAST(DATE '2024-01-01' AS TIMESTAMP) + (d.doc_id % 29) * INTERVAL '1' DAY
      + (d.doc_id % 1440) * INTERVAL '1' MINUTE AS date,
    CASE WHEN d.doc_id % 3 = 0 THEN CAST(1 + (d.doc_id * 7) % 5 AS INT) END AS stars,
    CASE WHEN d.doc_id % 3 = 0 THEN d.lang END AS location,
    CASE WHEN d.doc_id % 3 = 1 THEN concat('v', CAST(d.doc_id % 17 AS VARCHAR)) END AS videoid,
    CASE WHEN d.doc_id % 3 = 1 THEN CAST(d.n_chars % 101 AS INT) END AS like_count,
    CASE WHEN d.doc_id % 3 = 1 THEN CAST(d.n_chars % 13 AS INT) END AS youtube_reply_count,
    CASE WHEN d.doc_id % 3 = 2 THEN concat('sub_', d.lang) END AS subreddit,
    CASE WHEN d.doc_id % 3 = 2 THEN CAST(d.n_chars % 211 AS INT) END AS vote,
    CASE WHEN d.doc_id % 3 = 2 THEN CAST(d.n_chars % 29 AS INT) END AS reddit_reply_count,
    CAST(d.n_chars % 7 AS DOUBLE) / 2 AS logit_neg,
    CAST(d.n_chars % 5 AS DOUBLE) / 2 AS logit_neu,
    CAST(d.n_chars % 11 AS DOUBLE) / 4 AS logit_pos,
    CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
         WHEN l.quality = 0 THEN 'neutral' END AS gold_label
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
scored AS (
  SELECT *, CASE WHEN source <> 'trustpilot' THEN
     CASE WHEN logit_neg >= logit_neu AND logit_neg >= logit_pos THEN 'negative'
          WHEN logit_neu >= logit_pos THEN 'neutral' ELSE 'positive' END
    ELSE CASE WHEN stars > 3 THEN 'positive' WHEN stars = 3 THEN 'neutral' ELSE 'negative' END
    END AS sentiment
  FROM reviews
)"""


def with_fixture(body: str, ctes: str = "") -> str:
    """Prefix a query with the fixture CTEs; ``ctes`` adds further ``name AS (...)`` items."""
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return f"WITH {REVIEWS_SQL.strip()}{extra}\n{body.strip()}"
