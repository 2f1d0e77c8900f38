"""Landed JSON round trips: documents written from the tables, parsed back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from chorus.operators.ranking import source_quota
from chorus.plans.catalog import query
from chorus.plans.sqlviews import with_views
from chorus.sources import landed as L
from chorus.sources.sinks import output_dir
from chorus.sources.tables import posts, threads

SEEN_LIMIT = 20


_LISTING_SQL = """
SELECT id, title, selftext, score, url, CASE WHEN pos % 31 = 0 THEN '[deleted]' ELSE author END AS author,
       created_epoch, num_comments, CASE WHEN pos % 41 = 0 THEN 'unknown' ELSE subreddit END AS subreddit,
       CASE WHEN coalesce(permalink, '') <> '' AND NOT starts_with(permalink, 'http')
            THEN 'https://www.reddit.com' || permalink ELSE coalesce(permalink, '') END AS permalink,
       'Reddit' AS source
FROM posts WHERE source = 'Reddit' AND pos % 23 <> 0 AND pos % 58 <> 0 AND title <> ''"""


@query("ingest_listing_posts", with_views(f"""{_LISTING_SQL}
  AND id NOT IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY pos, id) AS rn FROM posts)
                 WHERE rn <= {SEEN_LIMIT // 2})""", "posts"))
def ingest_listing_posts(spark, sf):
    p = posts(spark, sf, urls=True)
    path = os.path.join(output_dir(spark, "listing"), "docs")
    L.land_listings(p, path)
    seen = source_quota(p, SEEN_LIMIT).select("id")
    return L.ingest_listing_posts(L.read_json(spark, path, L.LISTING_SCHEMA), seen)


@query("ingest_hits_posts", with_views("""
SELECT id, title, selftext, score,
       CASE WHEN pos % 11 = 3 THEN NULL WHEN url = '' THEN 'https://news.ycombinator.com/item?id=' || replace(id, 'hn_', '')
            ELSE url END AS url,
       author, created_epoch, num_comments, 'HackerNews' AS subreddit, 'HackerNews' AS source
FROM posts WHERE source = 'HackerNews' AND title <> ''""", "posts"))
def ingest_hits_posts(spark, sf):
    p = posts(spark, sf, urls=True)
    path = os.path.join(output_dir(spark, "hits"), "docs")
    L.land_hits(p, path)
    return L.ingest_hits_posts(spark.read.text(path))


_ALIVE = "{t} IS NOT NULL AND {t} <> '' AND {t} NOT IN ('[deleted]', '[removed]')"
_S4 = {
    "kt": f"""SELECT * FROM (SELECT post_id, thread_ix, text,
                row_number() OVER (PARTITION BY post_id ORDER BY thread_ix) - 1 AS k
              FROM threads WHERE post_id % 2 = 0 AND reply_ix = 0 AND (post_id + thread_ix) % 9 <> 0
                AND {_ALIVE.format(t='text')}) WHERE k < 30""",
}


@query("listing_threads", with_views(f"""
SELECT CAST(post_id AS VARCHAR) AS post_id, k AS thread_ix, 0 AS reply_ix, text FROM kt
UNION ALL
SELECT CAST(kt.post_id AS VARCHAR), kt.k, 1, r.text FROM kt JOIN threads r
  ON r.post_id = kt.post_id AND r.thread_ix = kt.thread_ix AND r.reply_ix = 1 WHERE {_ALIVE.format(t='r.text')}""",
                                     "threads", extra=_S4))
def listing_threads(spark, sf):
    path = os.path.join(output_dir(spark, "comment-listings"), "docs")
    L.land_comment_listings(threads(spark, sf), path)
    return L.listing_threads(L.read_json(spark, path, L.COMMENT_LISTING_SCHEMA))


_HN_ALIVE = "{t} IS NOT NULL AND {t} NOT IN ('[deleted]', '[removed]') AND trim({t}) <> ''"
_S5 = {
    "ht": f"""SELECT post_id, thread_ix, text, row_number() OVER (PARTITION BY post_id ORDER BY thread_ix) - 1 AS k
              FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY thread_ix) AS kid_rank
                                   FROM threads WHERE post_id % 2 = 1 AND reply_ix = 0) WHERE kid_rank <= 30)
              WHERE {_HN_ALIVE.format(t='text')}""",
}


@query("item_threads", with_views(f"""
SELECT 'hn_' || CAST(post_id AS VARCHAR) AS post_id, k AS thread_ix, 0 AS reply_ix, text FROM ht
UNION ALL
SELECT 'hn_' || CAST(ht.post_id AS VARCHAR), ht.k, 1, r.text FROM ht JOIN threads r
  ON r.post_id = ht.post_id AND r.thread_ix = ht.thread_ix AND r.reply_ix = 1 WHERE {_HN_ALIVE.format(t='r.text')}""",
                                  "threads", extra=_S5))
def item_threads(spark, sf):
    path = os.path.join(output_dir(spark, "items"), "docs")
    L.land_items(threads(spark, sf), path)
    return L.item_threads(L.read_json(spark, path, L.ITEM_SCHEMA))


@query("flat_comments", with_views("""
SELECT CAST(post_id AS VARCHAR) AS post_id, k AS ix, text FROM kt
UNION ALL
SELECT 'hn_' || CAST(post_id AS VARCHAR), row_number() OVER (PARTITION BY post_id ORDER BY h) - 1, text FROM (
  SELECT post_id, text, row_number() OVER (PARTITION BY post_id ORDER BY thread_ix, reply_ix) AS h
  FROM threads WHERE post_id % 2 = 1) WHERE h <= 30 AND text IS NOT NULL AND trim(text) <> ''""",
                                   "threads", extra=_S4))
def flat_comments(spark, sf):
    base = output_dir(spark, "flat-comments")
    t = threads(spark, sf)
    L.land_comment_listings(t, os.path.join(base, "listings"))
    L.land_comment_hits(t, os.path.join(base, "hits"))
    a = L.flat_listing_comments(L.read_json(spark, os.path.join(base, "listings"), L.COMMENT_LISTING_SCHEMA))
    b = L.flat_hit_comments(L.read_json(spark, os.path.join(base, "hits"), L.COMMENT_HITS_SCHEMA))
    return a.unionByName(b.select("post_id", F.col("ix").cast("int").alias("ix"), "text"))
