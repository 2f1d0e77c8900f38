"""Trends, shifts and source comparison over the events, in batch and as streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from chorus.plans.catalog import query
from chorus.plans.landed import _LISTING_SQL
from chorus.plans.sqlviews import with_views
from chorus.sources import landed as L
from chorus.sources.sinks import output_dir
from chorus.sources.tables import posts, read
from chorus.streaming import ingest as I
from chorus.streaming import shifts as S
from chorus.streaming import trends as T

SOURCE_A, SOURCE_B = "view", "click"

_EV = """
  SELECT topic_id, source, d, ts, CAST(round(s * 1000000) AS BIGINT) AS m FROM (
    SELECT user_id % 3 AS topic_id, event_type AS source, CAST(ts AS DATE) AS d, ts,
           greatest(-1.0, least(1.0, (value - 20) / 50)) AS s FROM events)"""
_MEAN = ("(CASE WHEN sum(m) < 0 THEN -1 ELSE 1 END) * CAST((2 * abs(CAST(sum(m) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) "
         "/ 1000000.0")


def _trend_sql(periods: str, lag: int, before: str, out: str) -> str:
    return f"""
WITH ev AS ({_EV}), per AS ({periods}),
prev AS (SELECT *, CASE WHEN lag(p, {lag}) OVER w = {before} THEN lag(mean, {lag}) OVER w END AS previous
         FROM per WINDOW w AS (PARTITION BY topic_id, source ORDER BY p)),
c AS (SELECT *, round(mean - previous, 6) AS change FROM prev)
SELECT topic_id, source, CAST(p AS VARCHAR) AS {out}, n, mean, previous, change,
       CASE WHEN change IS NULL THEN NULL WHEN change >= {T.FLAT} THEN 'up' WHEN change <= -{T.FLAT} THEN 'down' ELSE 'flat' END
         AS direction
FROM c"""


def _period_sql(unit: str, before: str) -> str:
    return _trend_sql(f"""SELECT topic_id, source, CAST(date_trunc('{unit}', d) AS DATE) AS p, count(*) AS n, {_MEAN} AS mean
                          FROM ev GROUP BY 1, 2, 3""", 1, before, "period")


@query("weekly_trend", _period_sql("week", "p - 7"))
def weekly_trend(spark, sf):
    """Mean score per topic, source and week against the week before."""
    return T.period_trend(read(spark, sf, "events"), "week")


@query("monthly_trend", _period_sql("month", "CAST(p - INTERVAL 1 MONTH AS DATE)"))
def monthly_trend(spark, sf):
    return T.period_trend(read(spark, sf, "events"), "month")


_SLIDING_SQL = _trend_sql(f"""SELECT topic_id, source, p, count(*) AS n, {_MEAN} AS mean FROM (
    SELECT topic_id, source, m, d - CAST(unnest(range({T.WINDOW_DAYS})) AS INTEGER) AS p FROM ev) GROUP BY 1, 2, 3""",
                          T.WINDOW_DAYS, f"p - {T.WINDOW_DAYS}", "start")


@query("sliding_trend", _SLIDING_SQL)
def sliding_trend(spark, sf):
    """Seven-day windows sliding by a day, each against the one just before it."""
    return T.sliding_trend(T.sliding_days(read(spark, sf, "events")))


@query("stream_sliding_trend", _SLIDING_SQL)
def stream_sliding_trend(spark, sf):
    base = output_dir(spark, "stream-trend")
    return T.stream_sliding_trend(spark, sf, os.path.join(base, "out"), os.path.join(base, "ckpt"))


def _shift_sql(until: str) -> str:
    hit = f"(days >= {S.WARMUP} AND (nu > {S.LIMIT} OR nl > {S.LIMIT}))"
    return f"""
WITH RECURSIVE ev AS ({_EV}),
last AS (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) AS t FROM events),
dm AS (SELECT topic_id, source, d, CAST(sum(m) AS DOUBLE) / 1000000.0::DOUBLE / count(*) AS mean FROM ev, last
       WHERE {until} GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY topic_id, source ORDER BY d) AS r FROM dm),
st AS (
  SELECT topic_id, source, d, mean, r, 1 AS days, mean AS base, 0.0::DOUBLE AS u, 0.0::DOUBLE AS l,
         NULL::VARCHAR AS direction, NULL::DOUBLE AS statistic, NULL::DOUBLE AS baseline FROM dr WHERE r = 1
  UNION ALL
  SELECT topic_id, source, d, mean, r, CASE WHEN {hit} THEN 1 ELSE days + 1 END,
         CASE WHEN {hit} THEN mean ELSE base + (mean - base) / (days + 1) END,
         CASE WHEN {hit} THEN 0.0::DOUBLE ELSE nu END, CASE WHEN {hit} THEN 0.0::DOUBLE ELSE nl END,
         CASE WHEN {hit} THEN CASE WHEN nu > {S.LIMIT} THEN 'up' ELSE 'down' END END,
         CASE WHEN {hit} THEN CASE WHEN nu > {S.LIMIT} THEN nu ELSE nl END END, CASE WHEN {hit} THEN base END
  FROM (SELECT dr.*, st.days, st.base,
               CASE WHEN st.days >= {S.WARMUP} THEN greatest(0.0::DOUBLE, st.u + (dr.mean - st.base - {S.SLACK}::DOUBLE)) ELSE st.u END AS nu,
               CASE WHEN st.days >= {S.WARMUP} THEN greatest(0.0::DOUBLE, st.l + (st.base - dr.mean - {S.SLACK}::DOUBLE)) ELSE st.l END AS nl
        FROM st JOIN dr ON dr.topic_id = st.topic_id AND dr.source = st.source AND dr.r = st.r + 1))
SELECT topic_id, source, CAST(d AS VARCHAR) AS day, direction, round(statistic, 6) AS statistic,
       round(baseline, 6) AS baseline, round(mean, 6) AS mean FROM st WHERE direction IS NOT NULL"""


@query("sentiment_shifts", _shift_sql("TRUE"))
def sentiment_shifts(spark, sf):
    """Days on which the cumulative-sum test of a (topic, source) finds a shift."""
    return S.sentiment_shifts(read(spark, sf, "events"))


@query("stream_sentiment_shifts", _shift_sql("epoch(d) + 86400 <= t - 86400"))
def stream_sentiment_shifts(spark, sf):
    """The same test with keyed state; days behind the watermark count."""
    base = output_dir(spark, "stream-shifts")
    return S.stream_sentiment_shifts(spark, sf, os.path.join(base, "out"), os.path.join(base, "ckpt"))


def _compare_sql(closed: str) -> str:
    hour = f"""SELECT topic_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS h, count(*) AS n, {_MEAN} AS mean
               FROM ev WHERE source = '{{}}' GROUP BY 1, 2"""
    return f"""
WITH ev AS ({_EV}),
wm AS (SELECT CAST(floor(epoch(least(max(ts) FILTER (WHERE source = '{SOURCE_A}'), max(ts) FILTER (WHERE source = '{SOURCE_B}'))))
              AS BIGINT) - 86400 AS t FROM ev),
a AS ({hour.format(SOURCE_A)}), b AS ({hour.format(SOURCE_B)})
SELECT a.topic_id, a.h AS hour_a, b.h AS hour_b, a.n AS n_a, b.n AS n_b, a.mean AS mean_a, b.mean AS mean_b,
       round(b.mean - a.mean, 6) AS gap
FROM a JOIN b ON a.topic_id = b.topic_id AND b.h BETWEEN a.h AND a.h + 7200, wm WHERE {closed}"""


@query("source_comparison", _compare_sql("TRUE"))
def source_comparison(spark, sf):
    """Hourly means of two sources on one topic, each hour of the first with the second's next hours."""
    return T.source_comparison(read(spark, sf, "events"), SOURCE_A, SOURCE_B)


@query("stream_source_comparison", _compare_sql("a.h + 3600 <= t AND b.h + 3600 <= t"))
def stream_source_comparison(spark, sf):
    """The same as a stream-stream join; hours behind the slower source's watermark count."""
    base = output_dir(spark, "stream-compare")
    return T.stream_source_comparison(spark, sf, os.path.join(base, "out"), os.path.join(base, "ckpt"), SOURCE_A, SOURCE_B)


_BROKEN = """{"kind":"Listing","page":%s,"data":{"children":["""
_NONE = ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in (
    ("title", "VARCHAR"), ("selftext", "VARCHAR"), ("score", "BIGINT"), ("url", "VARCHAR"), ("author", "VARCHAR"),
    ("created_epoch", "BIGINT"), ("num_comments", "BIGINT"), ("subreddit", "VARCHAR"), ("permalink", "VARCHAR"),
    ("source", "VARCHAR")))


@query("stream_listing_posts", with_views(f"""
SELECT 'post' AS status, * FROM ({_LISTING_SQL})
UNION ALL
SELECT 'broken' AS status, '{_BROKEN.split('%s')[0]}' || CAST(pos // 200 AS VARCHAR) || '{_BROKEN.split('%s')[1]}' AS id, {_NONE}
FROM posts WHERE source = 'Reddit' GROUP BY pos // 200""", "posts"))
def stream_listing_posts(spark, sf):
    """S1 as a stream over landed documents, half of them cut off in the middle."""
    base = output_dir(spark, "stream-listing")
    p = posts(spark, sf, urls=True)
    L.land_listings(p, os.path.join(base, "docs", "whole"))
    page = (F.col("pos") / 200).cast("long").cast("string")
    head, tail = _BROKEN.split("%s")
    p.where(F.col("source") == "Reddit").select(F.concat(F.lit(head), page, F.lit(tail)).alias("value")).distinct() \
        .write.text(os.path.join(base, "docs", "cut"))
    got, broken = I.stream_listing_posts(spark, os.path.join(base, "docs", "*"), os.path.join(base, "out"), os.path.join(base, "ckpt"))
    bad = broken.select(F.lit("broken").alias("status"), F.col("raw").alias("id"),
                        *(F.lit(None).cast(f.dataType).alias(f.name) for f in got.schema if f.name != "id"))
    return got.select(F.lit("post").alias("status"), *got.columns).unionByName(bad)
