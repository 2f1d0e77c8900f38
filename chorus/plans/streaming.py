"""Streaming queries: run to completion with an availableNow trigger."""

from __future__ import annotations

import os

from chorus.plans.catalog import query
from chorus.sources.sinks import output_dir
from chorus.streaming import daily as D


@query("stream_daily_sentiment", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id % 3 AS topic_id, event_type AS source,
       CASE WHEN user_id % 2 = 0 THEN 'rules' ELSE 'lexicon' END AS model_name,
       count(*) FILTER (WHERE s >= 0.05) AS positive_count, count(*) FILTER (WHERE s <= -0.05) AS negative_count,
       count(*) FILTER (WHERE s > -0.05 AND s < 0.05) AS neutral_count, 
       (2 * sum(CAST(round(abs(s) * 1000000) AS BIGINT)) + count(*)) // (2 * count(*)) / 1000000 AS avg_confidence
FROM (SELECT *, greatest(-1.0, least(1.0, (value - 20) / 50)) AS s FROM events) GROUP BY ALL""")
def stream_daily_sentiment(spark, sf):
    base = output_dir(spark, "stream-daily")
    return D.stream_daily_sentiment(spark, sf, os.path.join(base, "out"), os.path.join(base, "ckpt"))


@query("stream_dedup_posts", """
SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'Reddit' ELSE 'HackerNews' END AS source,
       md5(coalesce(text, '')) AS external_id FROM documents""")
def stream_dedup_posts(spark, sf):
    base = output_dir(spark, "stream-dedup")
    return D.stream_dedup_posts(spark, sf, os.path.join(base, "out"), os.path.join(base, "ckpt"))
