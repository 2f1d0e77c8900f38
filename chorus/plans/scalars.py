"""One query per scalar function, each over the whole posts binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.functions import text as X
from chorus.operators.sentiment import sentiment_scores
from chorus.plans.catalog import query
from chorus.plans.ranking import AS_OF
from chorus.plans.sentiment_sql import sentiment_ctes
from chorus.plans.sqlviews import with_views
from chorus.sources.tables import posts

TITLE_WIDTH = 60


@query("compact_score", with_views("""
SELECT id, score, CASE WHEN score >= 10000 THEN CAST(score // 1000 AS VARCHAR) || 'k'
  WHEN score >= 1000 THEN CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) || 'k'
  ELSE CAST(score AS VARCHAR) END AS score_display
FROM (SELECT id, score, CASE WHEN score % 100 > 50 OR (score % 100 = 50 AND (score // 100) % 2 = 1)
                             THEN score // 100 + 1 ELSE score // 100 END AS t FROM posts)""", "posts"))
def compact_score(spark, sf):
    return posts(spark, sf).select("id", "score", X.compact_score("score").alias("score_display"))


@query("age_bucket", with_views(f"""
SELECT id, CAST(CAST(make_timestamp(created_epoch * 1000000) AS DATE) AS VARCHAR) AS date_text,
  CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d <= 7 THEN 'last week' WHEN d <= 30 THEN 'last month'
       WHEN d <= 90 THEN '3 months' WHEN d <= 365 THEN 'this year' WHEN d // 365 = 1 THEN '1 year'
       ELSE CAST(d // 365 AS VARCHAR) || ' years' END AS age
FROM (SELECT id, created_epoch, CAST(floor(({AS_OF} - created_epoch) / 86400.0) AS BIGINT) AS d FROM posts)""", "posts"))
def age_bucket(spark, sf):
    p = posts(spark, sf)
    return p.select("id", X.utc_date("created_epoch").alias("date_text"), X.age_bucket("created_epoch", AS_OF).alias("age"))


@query("epoch_to_ts", with_views("""
SELECT id, created_epoch, strftime(make_timestamp(created_epoch * 1000000), '%Y-%m-%d %H:%M:%S') AS created_utc
FROM posts""", "posts"))
def epoch_to_ts(spark, sf):
    """Epoch seconds -> UTC timestamp text (formatted from epoch arithmetic, no session zone)."""
    e = F.col("created_epoch")
    day = X.utc_date(e)
    sod = e % 86400
    hms = F.format_string("%02d:%02d:%02d", (sod / 3600).cast("int"), ((sod % 3600) / 60).cast("int"),
                          (sod % 60).cast("int"))
    return posts(spark, sf).select("id", "created_epoch", F.concat(day, F.lit(" "), hms).alias("created_utc"))


@query("truncate_title", with_views(f"""
SELECT id, substr(replace(title, chr(65039), ''), 1, {TITLE_WIDTH - 1}) AS title_display FROM posts""", "posts"))
def truncate_title(spark, sf):
    return posts(spark, sf).select("id", X.truncate_title("title", TITLE_WIDTH).alias("title_display"))


@query("emoji_count", with_views(r"""
SELECT id, length(regexp_replace(title || ' ' || selftext, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS n_emoji
FROM posts""", "posts"))
def emoji_count(spark, sf):
    p = posts(spark, sf)
    return p.select("id", X.emoji_count(F.concat_ws(" ", "title", "selftext")).alias("n_emoji"))


@query("text_preview", with_views("""
SELECT id, CASE WHEN length(title || ' ' || selftext) > 100
            THEN trim(replace(substr(title || ' ' || selftext, 1, 100), chr(10), ' ')) || '...'
            ELSE trim(replace(substr(title || ' ' || selftext, 1, 100), chr(10), ' ')) END AS text_preview
FROM posts""", "posts"))
def text_preview(spark, sf):
    return posts(spark, sf).select("id", X.text_preview("title", "selftext").alias("text_preview"))


@query("safe_query", with_views("""
SELECT id, translate(subreddit || ' / ' || author, ' /', '__') AS safe_name FROM posts""", "posts"))
def safe_query(spark, sf):
    """X16 on a per-row string (community / author), so it runs over the table."""
    p = posts(spark, sf)
    return p.select("id", X.safe_query(F.concat_ws(" / ", "subreddit", "author")).alias("safe_name"))


@query("keyword_matches", with_views("""
SELECT id, CAST(instr(lower(title || ' ' || selftext), 'claude') > 0 AS INTEGER)
         + CAST(instr(lower(title || ' ' || selftext), 'sonnet') > 0 AS INTEGER)
         + CAST(instr(lower(title || ' ' || selftext), 'coding') > 0 AS INTEGER) AS keyword_matches FROM posts""",
                                     "posts"))
def keyword_matches(spark, sf):
    return posts(spark, sf).select("id", X.keyword_matches("title", "selftext", ["claude", "sonnet", "coding"])
                                   .alias("keyword_matches"))


_T = {"sent_in": "SELECT id AS sid, title AS text FROM posts"}
_T.update(sentiment_ctes())


@query("sentiment_classes", with_views("""
SELECT sid AS id, CASE WHEN compound > 0.05 THEN 'positive' WHEN compound < -0.05 THEN 'negative' ELSE 'neutral' END
         AS strip_class,
       CASE WHEN compound > 0 THEN 'positive' WHEN compound < 0 THEN 'negative' ELSE 'neutral' END AS sign_class
FROM sent_out""", "posts", extra=_T))
def sentiment_classes(spark, sf):
    """X7 strict strip class and X8 sign class of the title compound."""
    s = sentiment_scores(posts(spark, sf).select("id", "title"), "id", "title")
    return s.select("id", X.strip_class("compound").alias("strip_class"), X.sign_class("compound").alias("sign_class"))


@query("length_bucket", with_views("""
SELECT id, CASE WHEN length(selftext) = 0 THEN 0 WHEN length(selftext) < 50 THEN 1 WHEN length(selftext) < 100 THEN 2
  WHEN length(selftext) < 200 THEN 3 WHEN length(selftext) < 400 THEN 4 WHEN length(selftext) < 600 THEN 5
  WHEN length(selftext) < 800 THEN 6 ELSE 7 END AS bucket FROM posts""", "posts"))
def length_bucket(spark, sf):
    return posts(spark, sf).select("id", X.length_bucket("selftext").alias("bucket"))
