"""Ranking, quota, filter, link and set-operation queries over the posts binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus import vocab
from chorus.functions import text as X
from chorus.operators import ranking as R
from chorus.plans.catalog import query
from chorus.plans.common import sql_in_list
from chorus.plans.sqlviews import with_views
from chorus.sources.tables import posts, threads

TERMS = X.query_terms(vocab.DEFAULT_QUERY)
LIMIT = 20
TOPUP_LIMIT = 40
TOPUP_TERM = "haiku"
AS_OF = 1705708800  # 2024-01-20T00:00:00Z, the "now" of age labels

_SQL_STATS = """
  SELECT source, count(*) AS n, avg(score) AS mean_score,
         CASE WHEN stddev_pop(score) > 0 THEN stddev_pop(score) ELSE 1.0 END AS std_score
  FROM posts GROUP BY source"""
_SQL_Z = """
  SELECT p.*, CASE WHEN p.source IN ('Reddit', 'HackerNews') THEN (p.score - s.mean_score) / s.std_score
                   ELSE 0.0 END AS normalized_score
  FROM posts p LEFT JOIN stats s ON p.source = s.source"""
_SQL_KM = " + ".join(f"CAST(instr(lower(title || ' ' || selftext), {vocab.sql_literal(t)}) > 0 AS INTEGER)"
                     for t in TERMS)


@query("source_score_stats", with_views(_SQL_STATS, "posts"))
def source_score_stats(spark, sf):
    return R.source_score_stats(posts(spark, sf))


@query("zscore_rank", with_views("""
SELECT id, source, score, round(normalized_score, 6) AS normalized_score FROM z""",
                                 "posts", extra={"stats": _SQL_STATS, "z": _SQL_Z}))
def zscore_rank(spark, sf):
    z = R.zscore(posts(spark, sf))
    return z.select("id", "source", "score", F.round("normalized_score", 6).alias("normalized_score")) \
        .orderBy(F.desc("normalized_score"), F.asc("id"))


@query("top_posts", with_views("""
SELECT id, source, score, round(normalized_score, 6) AS normalized_score,
       row_number() OVER (ORDER BY normalized_score DESC, id) AS rank
FROM z ORDER BY normalized_score DESC, id LIMIT 10""", "posts", extra={"stats": _SQL_STATS, "z": _SQL_Z}))
def top_posts(spark, sf):
    top = R.top_k(R.zscore(posts(spark, sf)), 10, F.desc("normalized_score"), F.asc("id"))
    ranked = R.with_rank(top, F.desc("normalized_score"), F.asc("id"))
    return ranked.select("id", "source", "score", F.round("normalized_score", 6).alias("normalized_score"), "rank")


@query("posts_by_date", with_views(f"""
SELECT id, created_epoch, CAST(CAST(make_timestamp(created_epoch * 1000000) AS DATE) AS VARCHAR) AS created_date
FROM posts""", "posts"))
def posts_by_date(spark, sf):
    p = posts(spark, sf)
    return p.select("id", "created_epoch", X.utc_date("created_epoch").alias("created_date")) \
        .orderBy(F.desc("created_epoch"), F.asc("id"))


@query("rank_or_results", with_views(f"""
SELECT id, score, num_comments, keyword_matches FROM (
  SELECT id, score, num_comments, {_SQL_KM} AS keyword_matches FROM posts)
ORDER BY keyword_matches DESC, score DESC, num_comments DESC, id LIMIT {LIMIT}""", "posts"))
def rank_or_results(spark, sf):
    return R.rank_or_results(posts(spark, sf), TERMS, LIMIT).select("id", "score", "num_comments", "keyword_matches")


@query("per_source_quota", with_views(f"""
SELECT id, source, pos, rn FROM (
  SELECT id, source, pos, row_number() OVER (PARTITION BY source ORDER BY pos, id) AS rn FROM posts)
WHERE rn <= {LIMIT // 2}""", "posts"))
def per_source_quota(spark, sf):
    return R.source_quota(posts(spark, sf), LIMIT).select("id", "source", "pos", "rn")


_TQ = max(2 * LIMIT // len(TERMS), 3)
_SQL_TERMS = "(VALUES " + ", ".join(f"({i}, {vocab.sql_literal(t)})" for i, t in enumerate(TERMS)) + ") AS t(term_ix, term)"
_SQL_TERM_QUOTA = f"""
  SELECT * FROM (
    SELECT p.id, p.pos, t.term_ix, t.term,
           row_number() OVER (PARTITION BY t.term_ix ORDER BY p.pos, p.id) AS term_rank
    FROM posts p JOIN {_SQL_TERMS} ON instr(lower(p.title || ' ' || p.selftext), t.term) > 0)
  WHERE term_rank <= {_TQ}"""


@query("per_term_quota", with_views("SELECT id, pos, term_ix, term, term_rank FROM tq", "posts",
                                    extra={"tq": _SQL_TERM_QUOTA}))
def per_term_quota(spark, sf):
    return R.term_quota(posts(spark, sf), TERMS, LIMIT).select("id", "pos", "term_ix", "term", "term_rank")


@query("first_wins_dedup", with_views("""
SELECT id, arg_min(term, (term_ix, term_rank)) AS term, min(term_ix) AS term_ix FROM tq GROUP BY id""",
                                      "posts", extra={"tq": _SQL_TERM_QUOTA}))
def first_wins_dedup(spark, sf):
    tq = R.term_quota(posts(spark, sf), TERMS, LIMIT).select("id", "term_ix", "term_rank", "term")
    return R.first_wins(tq, "id", ["term_ix", "term_rank"]).select("id", "term", "term_ix")


@query("topup_to_limit", with_views(f"""
SELECT id, source, pos FROM taken
UNION ALL
SELECT id, source, pos FROM cand
WHERE source = 'Reddit' AND rn > {TOPUP_LIMIT // 2}
  AND rn <= {TOPUP_LIMIT // 2} + ({TOPUP_LIMIT} - (SELECT count(*) FROM taken))""", "posts", extra={
    "cand": f"""SELECT id, source, pos, row_number() OVER (PARTITION BY source ORDER BY pos, id) AS rn
              FROM posts WHERE instr(lower(title || ' ' || selftext), '{TOPUP_TERM}') > 0""",
    "taken": f"SELECT * FROM cand WHERE rn <= {TOPUP_LIMIT // 2}"}))
def topup_to_limit(spark, sf):
    p = posts(spark, sf).where(X.topic_match("title", "selftext", [TOPUP_TERM]))
    return R.topup_to_limit(p.select("id", "source", "pos"), TOPUP_LIMIT)


@query("filter_platform", with_views("SELECT id, source FROM posts WHERE source = 'HackerNews'", "posts"))
def filter_platform(spark, sf):
    return R.filter_platform(posts(spark, sf), "hackernews").select("id", "source")


@query("topic_match_or", with_views(f"""
SELECT id, keyword_matches FROM (SELECT id, {_SQL_KM} AS keyword_matches FROM posts) WHERE keyword_matches > 0""",
                                    "posts"))
def topic_match_or(spark, sf):
    p = posts(spark, sf)
    return p.where(X.topic_match("title", "selftext", TERMS)).select(
        "id", X.keyword_matches("title", "selftext", TERMS).alias("keyword_matches"))


@query("min_engagement", with_views("SELECT id, score FROM posts WHERE source = 'HackerNews' AND score > 0", "posts"))
def min_engagement(spark, sf):
    return posts(spark, sf).where((F.col("source") == "HackerNews") & (F.col("score") > 0)).select("id", "score")


@query("drop_tombstones", with_views("""
SELECT post_id, thread_ix, reply_ix, text FROM threads
WHERE text IS NOT NULL AND text NOT IN ('[deleted]', '[removed]') AND trim(text) <> ''""", "threads"))
def drop_tombstones(spark, sf):
    t = threads(spark, sf)
    return t.where(F.col("text").isNotNull() & ~F.col("text").isin("[deleted]", "[removed]")
                   & (F.trim("text") != ""))


_SQL_INTERNAL = vocab.sql_values("internal_url_prefixes")


@query("eligible_urls", with_views(f"""
SELECT p.id, p.source, p.url FROM posts p
WHERE p.url IS NOT NULL AND p.url <> ''
  AND NOT EXISTS (SELECT 1 FROM {_SQL_INTERNAL} r WHERE r.source = p.source AND starts_with(p.url, r.prefix))""",
                                   "posts"))
def eligible_urls(spark, sf):
    return R.eligible_urls(posts(spark, sf, urls=True)).select("id", "source", "url")


_SQL_DISC = """CASE WHEN source = 'Reddit' THEN
      CASE WHEN coalesce(id, '') = '' THEN '' ELSE 'https://www.reddit.com/r/' || coalesce(subreddit, 'unknown') || '/comments/' || id || '/' END
    WHEN source = 'HackerNews' THEN
      CASE WHEN starts_with(id, 'hn_') THEN 'https://news.ycombinator.com/item?id=' || replace(id, 'hn_', '') ELSE url END
    ELSE url END"""


@query("discussion_url", with_views(f"SELECT id, {_SQL_DISC} AS discussion_url FROM posts", "posts"))
def discussion_url(spark, sf):
    p = posts(spark, sf, urls=True)
    return p.select("id", R.discussion_url(F.col("source"), F.col("id"), F.col("subreddit"), F.col("url"))
                    .alias("discussion_url"))


_SQL_PERMA = """CASE WHEN permalink IS NULL OR permalink = '' THEN permalink
    WHEN starts_with(permalink, 'http') THEN permalink ELSE 'https://www.reddit.com' || permalink END"""


@query("absolute_permalink", with_views(f"SELECT id, {_SQL_PERMA} AS permalink FROM posts", "posts"))
def absolute_permalink(spark, sf):
    return posts(spark, sf).select("id", R.absolute_permalink(F.col("permalink")).alias("permalink"))


@query("display_links", with_views(f"""
SELECT id, CASE
    WHEN source = 'HackerNews' THEN CASE WHEN coalesce(url, '') <> d THEN [d, coalesce(url, '')] ELSE [d] END
    WHEN coalesce(url, '') <> '' AND NOT (starts_with(url, 'https://www.reddit.com/') OR starts_with(url, 'https://v.redd.it/')
                                          OR starts_with(url, 'https://i.redd.it/'))
      THEN [CASE WHEN coalesce(pl, '') <> '' THEN pl ELSE d END, url]
    ELSE [CASE WHEN coalesce(pl, '') <> '' THEN pl
               WHEN starts_with(coalesce(url, ''), 'https://www.reddit.com/') AND contains(url, '/comments/') THEN url
               ELSE d END] END AS links
FROM (SELECT *, {_SQL_DISC} AS d, {_SQL_PERMA.replace('permalink', 'permalink')} AS pl FROM posts)""", "posts"))
def display_links(spark, sf):
    p = posts(spark, sf, urls=True)
    d = R.discussion_url(F.col("source"), F.col("id"), F.col("subreddit"), F.col("url"))
    return p.select("id", R.display_links(F.col("source"), F.col("url"), d,
                                          R.absolute_permalink(F.col("permalink"))).alias("links"))


@query("union_sources", with_views("""
SELECT id, source, permalink FROM posts WHERE source = 'Reddit'
UNION ALL SELECT id, source, NULL AS permalink FROM posts WHERE source = 'HackerNews'""", "posts"))
def union_sources(spark, sf):
    p = posts(spark, sf)
    reddit = p.where(F.col("source") == "Reddit").select("id", "source", "permalink")
    hn = p.where(F.col("source") == "HackerNews").select("id", "source")
    return reddit.unionByName(hn, allowMissingColumns=True)


@query("union_distinct_ids", with_views(f"""
SELECT id, min(batch) AS batch FROM (
  SELECT id, 0 AS batch FROM posts WHERE source = 'Reddit' AND pos < 400
  UNION ALL SELECT id, 1 AS batch FROM posts WHERE source = 'Reddit' AND pos >= 200) GROUP BY id""", "posts"))
def union_distinct_ids(spark, sf):
    p = posts(spark, sf).where(F.col("source") == "Reddit")
    a = p.where(F.col("pos") < 400).select("id", F.lit(0).alias("batch"))
    b = p.where(F.col("pos") >= 200).select("id", F.lit(1).alias("batch"))
    return R.first_wins(a.unionByName(b), "id", ["batch"])


@query("anti_seen_ids", with_views(f"""
SELECT p.id FROM posts p WHERE p.source = 'Reddit'
  AND p.id NOT IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY pos, id) AS rn FROM posts)
                   WHERE rn <= {LIMIT // 2})""", "posts"))
def anti_seen_ids(spark, sf):
    p = posts(spark, sf)
    seen = R.source_quota(p, LIMIT).select("id")
    return p.where(F.col("source") == "Reddit").select("id").join(seen, "id", "left_anti")


_SOURCE_DIM = [("Reddit", "r/", True), ("HackerNews", "", False)]


@query("source_dim", with_views("""
SELECT p.id, p.src AS source,
       CASE WHEN d.source IS NULL THEN p.src WHEN d.per_community THEN d.prefix || p.subreddit ELSE d.source END AS source_display
FROM (SELECT id, subreddit, CASE WHEN pos % 10 = 9 THEN 'Lobsters' ELSE source END AS src FROM posts) p
LEFT JOIN (VALUES ('Reddit', 'r/', TRUE), ('HackerNews', '', FALSE)) AS d(source, prefix, per_community)
  ON p.src = d.source""", "posts"))
def source_dim(spark, sf):
    """Per-source display rules from a small dimension; unknown sources fall back to the raw name."""
    dim = F.broadcast(spark.createDataFrame(_SOURCE_DIM, "source string, prefix string, per_community boolean"))
    p = posts(spark, sf).select("id", "subreddit",
                                F.when(F.col("pos") % 10 == 9, F.lit("Lobsters")).otherwise(F.col("source")).alias("src"))
    j = p.join(dim, p.src == dim.source, "left")
    disp = (F.when(dim.source.isNull(), p.src)
            .when(dim.per_community, F.concat(dim.prefix, p.subreddit)).otherwise(dim.source))
    return j.select("id", p.src.alias("source"), disp.alias("source_display"))
