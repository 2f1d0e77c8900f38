"""Store tables derived from the analysed posts, and the queries over them."""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import functions as F

from chorus import vocab
from chorus.functions import text as X
from chorus.operators import store as ST
from chorus.operators.content import content_records
from chorus.operators.mentions import product_version
from chorus.operators.ranking import eligible_urls
from chorus.operators.sentiment import sentiment_scores
from chorus.plans import content as PC
from chorus.plans import mentions as PM
from chorus.plans.catalog import query
from chorus.plans.common import sql_in_list, sql_tokens
from chorus.plans.sentiment_sql import sentiment_ctes
from chorus.plans.sqlviews import with_views
from chorus.session import cut_lineage
from chorus.sources import sinks
from chorus.sources import store as SS
from chorus.sources.tables import posts, read

EXECUTED_AT = "2024-02-01T00:00:00Z"
N_RUNS = 3
TABLES = ("search_queries", "posts", "content", "sentiment_analyses")


def derive_scored(spark, sf):
    """Every post with its title scores, run, label and product version. Urls and scores are joined on
    ``pos`` (one to one with ``id``), so the texts are shuffled once for both."""
    p = posts(spark, sf, urls=True)
    t = sentiment_scores(p.select("pos", "title"), "pos", "title").select(
        "pos", F.col("compound").alias("title_compound"), F.col("positive").alias("title_positive"),
        F.col("neutral").alias("title_neutral"), F.col("negative").alias("title_negative"))
    return (p.join(t, "pos").select(*p.columns, *(c for c in t.columns if c != "pos"))
            .withColumn("search_query_id", (F.col("pos") % N_RUNS + 1).cast("int"))
            .withColumn("sentiment_label", X.sentiment_label("title_compound"))
            .withColumn("claude_version", product_version(F.concat_ws(" ", "title", "selftext"))))


def derive_content(spark, sf):
    """(id, content_text, content_compound) of every post whose link should be fetched; NULL where
    that gave no text."""
    elig = eligible_urls(posts(spark, sf, urls=True)).select("id", "pos", "url")
    cr = cut_lineage(content_records(elig, read(spark, sf, "pages")))
    cs = sentiment_scores(cr, "post_id", "content_text").select("post_id", F.col("compound").alias("content_compound"))
    got = cr.select("post_id", "content_text").join(cs, "post_id").withColumnRenamed("post_id", "id")
    return elig.select("id", "pos").join(got, "id", "left")


def _inputs(sf):
    return [os.path.join(sf, f"{t}.parquet") for t in ("documents", "pages")]


def scored_posts(spark, sf):
    """The scored posts of a run, written once and read by every query over them."""
    def build(path):
        derive_scored(spark, sf).withColumn(SS.RUN, F.col("search_query_id")).write.partitionBy(SS.RUN) \
            .parquet(os.path.join(path, "scored"))
        return ["scored"]
    return SS.persisted(spark, "scored", _inputs(sf), build)["scored"].drop(SS.RUN)


def store_tables(scored, content):
    """The four tables of scored posts and their content, each with the run it belongs to;
    JSON documents as text."""
    run = F.col("search_query_id").alias(SS.RUN)
    sq = ST.run_stats(scored).select(
        F.col("search_query_id").alias("id"),
        F.concat(F.lit(vocab.DEFAULT_QUERY + " #"), F.col("search_query_id").cast("string")).alias("query"),
        F.lit("VADER").alias("analysis_method"), "total_posts", "reddit_posts", "hackernews_posts",
        "avg_sentiment", F.lit(EXECUTED_AT).alias("executed_at"), run)
    po = scored.select(
        "id", F.when(F.col("pos") % 97 == 13, F.lit(99)).otherwise(F.col("search_query_id")).alias("search_query_id"),
        "title", "source", F.col("subreddit").alias("community"), "score", "created_epoch",
        F.to_json(F.struct("author", "url", "num_comments")).alias("raw_data"),
        F.lit(EXECUTED_AT).alias("collected_at"), run)
    ok = F.col("content_text").isNotNull()
    co = content.select(
        F.col("pos").alias("id"),
        F.when(F.col("pos") % 89 == 11, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id")).alias("post_id"),
        ok.alias("fetch_success"), F.length("content_text").alias("content_length"),
        F.when(ok & (F.col("pos") % 13 == 4), F.to_json(F.struct(F.lit("truncated").alias("note"))))
        .when(ok, F.to_json(F.struct("content_text")))
        .otherwise(F.to_json(F.struct(F.lit("no page").alias("error")))).alias("fetch_details"),
        (F.col("pos") % N_RUNS + 1).cast("int").alias(SS.RUN))
    kw = F.filter(X.tokens_az3("title"), lambda w: w.isin(ST.KEYWORDS))
    full = F.to_json(F.struct(F.struct(kw.alias("keywords")).alias("extracted_features"),
                              F.struct((F.col("pos") % 500).alias("processing_time_ms")).alias("analysis_metadata")))
    own = content.where(ok).select("id", F.col("pos").alias("content_id"), "content_compound")
    # a post is stored once, every 19th a second time under an id of its own
    ids = F.when(F.col("pos") % 19 == 7, F.array(F.col("pos"), F.col("pos") + 1000000)).otherwise(F.array("pos"))
    sa = scored.join(own, "id", "left").select(
        F.explode(ids).alias("id"), F.col("id").alias("post_id"), "content_id", F.lit("VADER").alias("analysis_method"),
        ST.decimal_4_3(F.col("title_compound")).alias("title_compound"), F.col("sentiment_label").alias("title_label"),
        ST.decimal_4_3(F.col("content_compound")).alias("content_compound"),
        F.when(F.col("content_compound").isNotNull(), X.sentiment_label("content_compound")).alias("content_label"),
        "claude_version", full.alias("full_results"), F.lit(EXECUTED_AT).alias("analyzed_at"), run)
    return {"search_queries": sq, "posts": po, "content": co, "sentiment_analyses": sa}


def build_store(spark, sf, path):
    SS.save(store_tables(scored_posts(spark, sf), cut_lineage(derive_content(spark, sf))), path)
    return list(TABLES)


def stored(spark, sf):
    """The store's tables, read back; built from the scored posts by the first query that asks."""
    return SS.persisted(spark, "store", _inputs(sf), lambda path: build_store(spark, sf, path))


# ------------------------------------------------------------------ SQL side
_DEC = "CAST(CAST({x} AS DECIMAL(10,4)) AS DECIMAL(4,3))"
_LABEL = "CASE WHEN {x} >= 0.05 THEN 'positive' WHEN {x} <= -0.05 THEN 'negative' ELSE 'neutral' END"
_S: dict[str, str] = {}
_S.update(PC._CONTENT)
_S["sent_in"] = "SELECT id AS sid, title AS text FROM posts UNION ALL SELECT 'C' || post_id, content_text FROM content"
_S.update(sentiment_ctes())
_S["sp"] = f"""
  SELECT p.*, s.compound AS title_compound, s.positive AS title_positive, s.neutral AS title_neutral,
         s.negative AS title_negative, CAST(p.pos % {N_RUNS} + 1 AS INTEGER) AS search_query_id,
         {_LABEL.format(x='s.compound')} AS sentiment_label, v.claude_version
  FROM posts p JOIN sent_out s ON s.sid = p.id JOIN ({PM._SQL_PV}) v ON v.id = p.id"""
_S["run_stats"] = f"""
  SELECT search_query_id, count(*) AS total_posts, count(*) FILTER (WHERE source = 'Reddit') AS reddit_posts,
         count(*) FILTER (WHERE source = 'HackerNews') AS hackernews_posts,
         {_DEC.format(x='avg(title_compound)')} AS avg_sentiment
  FROM sp GROUP BY search_query_id"""
_S["st_search_queries"] = f"""
  SELECT search_query_id AS id, '{vocab.DEFAULT_QUERY} #' || CAST(search_query_id AS VARCHAR) AS query,
         'VADER' AS analysis_method, total_posts, reddit_posts, hackernews_posts, avg_sentiment,
         '{EXECUTED_AT}' AS executed_at FROM run_stats"""
_S["st_posts"] = f"""
  SELECT id, CASE WHEN pos % 97 = 13 THEN 99 ELSE search_query_id END AS search_query_id, title, source,
         subreddit AS community, score, created_epoch,
         to_json({{'author': author, 'url': url, 'num_comments': num_comments}}) AS raw_data,
         '{EXECUTED_AT}' AS collected_at FROM sp"""
_S["co_full"] = """SELECT e.id, p.pos, e.url, c.content_text FROM eligible e JOIN posts p ON p.id = e.id
                   LEFT JOIN content c ON c.post_id = e.id"""
_S["st_content"] = """
  SELECT pos AS id, CASE WHEN pos % 89 = 11 THEN 'x' || id ELSE id END AS post_id,
         content_text IS NOT NULL AS fetch_success, length(content_text) AS content_length,
         CASE WHEN content_text IS NOT NULL AND pos % 13 = 4 THEN to_json({'note': 'truncated'})
              WHEN content_text IS NOT NULL THEN to_json({'content_text': content_text})
              ELSE to_json({'error': 'no page'}) END AS fetch_details
  FROM co_full"""
_KW = f"list_filter({sql_tokens('sp.title')}, lambda w: w IN {sql_in_list(ST.KEYWORDS)})"
_S["sa1"] = f"""
  SELECT sp.pos AS id, sp.id AS post_id, c.pos AS content_id, 'VADER' AS analysis_method,
         {_DEC.format(x='sp.title_compound')} AS title_compound, sp.sentiment_label AS title_label,
         {_DEC.format(x='cs.compound')} AS content_compound,
         CASE WHEN cs.compound IS NOT NULL THEN {_LABEL.format(x='cs.compound')} END AS content_label,
         sp.claude_version,
         to_json({{'extracted_features': {{'keywords': {_KW}}},
                   'analysis_metadata': {{'processing_time_ms': sp.pos % 500}}}}) AS full_results,
         '{EXECUTED_AT}' AS analyzed_at, sp.pos
  FROM sp LEFT JOIN (SELECT * FROM co_full WHERE content_text IS NOT NULL) c ON c.id = sp.id
  LEFT JOIN sent_out cs ON cs.sid = 'C' || sp.id"""
_S["st_sentiment_analyses"] = """
  SELECT * EXCLUDE (pos) FROM sa1 UNION ALL SELECT * EXCLUDE (pos) REPLACE (id + 1000000 AS id) FROM sa1 WHERE pos % 19 = 7"""


def _sql(body: str) -> str:
    return with_views(body, "posts", extra=_S)


_COUNTS_SQL = """
SELECT 'search_queries' AS table_name, count(*) AS n_rows FROM st_search_queries
UNION ALL SELECT 'posts', count(*) FROM st_posts
UNION ALL SELECT 'content', count(*) FROM st_content
UNION ALL SELECT 'sentiment_analyses', count(*) FROM st_sentiment_analyses"""


def _counts(tables):
    out = None
    for name in TABLES:
        c = tables[name].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


@query("table_status", _sql(_COUNTS_SQL))
def table_status(spark, sf):
    """Row count per store table."""
    return _counts(stored(spark, sf))


# every stored column; of a JSON document, every field it can hold
_COLUMNS = {
    "search_queries": ["id", "query", "analysis_method", "total_posts", "reddit_posts", "hackernews_posts",
                       "avg_sentiment", "executed_at"],
    "posts": ["id", "search_query_id", "title", "source", "community", "score", "created_epoch", "collected_at",
              ("raw_data", "author"), ("raw_data", "num_comments"), ("raw_data", "url")],
    "content": ["id", "post_id", "fetch_success", "content_length", ("fetch_details", "content_text"),
                ("fetch_details", "error"), ("fetch_details", "note")],
    "sentiment_analyses": ["id", "post_id", "content_id", "analysis_method", "title_compound", "title_label",
                           "content_compound", "content_label", "claude_version", "analyzed_at",
                           ("full_results", "analysis_metadata.processing_time_ms"),
                           *(("full_results", f"extracted_features.keywords[{i}]") for i in range(4))],
}


def _row_sql(table: str, cols: list) -> str:
    def value(c):
        return f"CAST({c} AS VARCHAR)" if isinstance(c, str) else f"json_extract_string({c[0]}, '$.{c[1]}')"
    row = " || '|' || ".join(f"coalesce({value(c)}, '~')" for c in cols)
    return f"SELECT '{table}' AS table_name, CAST(id AS VARCHAR) AS id, {row} AS stored FROM st_{table}"


@query("write_store", _sql(" UNION ALL ".join(_row_sql(t, c) for t, c in _COLUMNS.items())))
def write_store(spark, sf):
    """Write the four tables (partitioned by run, documents as VARIANT) and return every row
    read back, the fields of its documents included."""
    path = sinks.output_dir(spark, "store")
    back = SS.load(spark, path, build_store(spark, sf, path))

    def value(c):
        return F.col(c).cast("string") if isinstance(c, str) else F.variant_get(c[0], f"$.{c[1]}", "string")
    out = None
    for table, cols in _COLUMNS.items():
        row = F.concat_ws("|", *[F.coalesce(value(c), F.lit("~")) for c in cols])
        df = back[table].select(F.lit(table).alias("table_name"), F.col("id").cast("string").alias("id"), row.alias("stored"))
        out = df if out is None else out.unionByName(df)
    return out


@query("run_stats", _sql("SELECT search_query_id, total_posts, reddit_posts, hackernews_posts, avg_sentiment FROM run_stats"))
def run_stats(spark, sf):
    return ST.run_stats(scored_posts(spark, sf))


@query("decimal_4_3", _sql("SELECT id, title_compound, " + _DEC.format(x="title_compound") + " AS stored FROM sp"))
def decimal_4_3(spark, sf):
    sp = scored_posts(spark, sf)
    return sp.select("id", "title_compound", ST.decimal_4_3(F.col("title_compound")).alias("stored"))


@query("store_filter", _sql("""
SELECT id, post_id, CAST(title_compound AS DOUBLE) AS title_compound FROM st_sentiment_analyses
WHERE title_compound > 0.5 AND title_label = 'positive'"""))
def store_filter(spark, sf):
    """title_compound > 0.5 AND title_label = 'positive' on the stored table; both reach the parquet scan."""
    sa = stored(spark, sf)["sentiment_analyses"]
    return sa.where((F.col("title_compound") > F.lit(Decimal("0.500"))) & (F.col("title_label") == "positive")).select(
        "id", "post_id", F.col("title_compound").cast("double").alias("title_compound"))


@query("json_contains_key", _sql("""
SELECT id, post_id FROM st_sentiment_analyses
WHERE list_contains(CAST(json_extract(full_results, '$.extracted_features.keywords') AS VARCHAR[]), 'claude')"""))
def json_contains_key(spark, sf):
    """stored documents whose extracted_features.keywords array holds 'claude'."""
    sa = stored(spark, sf)["sentiment_analyses"]
    kws = F.variant_get("full_results", "$.extracted_features.keywords", "array<string>")
    return sa.where(F.array_contains(kws, "claude")).select("id", "post_id")


@query("join_posts_sentiment", _sql("""
SELECT p.id, p.title, CAST(s.title_compound AS DOUBLE) AS title_compound,
       CAST(json_extract_string(s.full_results, '$.analysis_metadata.processing_time_ms') AS BIGINT) AS processing_time_ms
FROM st_posts p JOIN st_sentiment_analyses s ON s.post_id = p.id
WHERE s.title_compound > 0.8 AND p.source = 'Reddit'"""))
def join_posts_sentiment(spark, sf):
    """Posts joined to analyses, processing time taken from the JSON document, filters on both sides."""
    t = stored(spark, sf)
    p = t["posts"].where(F.col("source") == "Reddit")
    s = t["sentiment_analyses"].where(F.col("title_compound") > F.lit(Decimal("0.800")))
    return p.join(s, s.post_id == p.id).select(
        p.id, p.title, s.title_compound.cast("double").alias("title_compound"),
        F.variant_get(s.full_results, "$.analysis_metadata.processing_time_ms", "bigint").alias("processing_time_ms"))


@query("fk_navigation", _sql("""
SELECT q.id AS search_query_id, count(DISTINCT p.id) AS n_posts, count(DISTINCT c.id) AS n_content,
       count(DISTINCT a.id) AS n_analyses
FROM st_search_queries q JOIN st_posts p ON p.search_query_id = q.id
LEFT JOIN st_content c ON c.post_id = p.id LEFT JOIN st_sentiment_analyses a ON a.post_id = p.id
GROUP BY q.id"""))
def fk_navigation(spark, sf):
    """Search query -> posts -> content (optional) / analyses, counted per query."""
    t = stored(spark, sf)
    q, p = t["search_queries"].select(F.col("id").alias("search_query_id")), t["posts"]
    c = t["content"].groupBy("post_id").agg(F.countDistinct("id").alias("nc"))
    a = t["sentiment_analyses"].groupBy("post_id").agg(F.countDistinct("id").alias("na"))
    j = q.join(p.select("id", "search_query_id"), "search_query_id") \
        .join(c.withColumnRenamed("post_id", "id"), "id", "left").join(a.withColumnRenamed("post_id", "id"), "id", "left")
    return j.groupBy("search_query_id").agg(F.countDistinct("id").alias("n_posts"),
                                            F.coalesce(F.sum("nc"), F.lit(0)).cast("long").alias("n_content"),
                                            F.coalesce(F.sum("na"), F.lit(0)).cast("long").alias("n_analyses"))


@query("fk_orphans", _sql("""
SELECT 'posts.search_query_id' AS fk, count(*) AS n_orphans FROM st_posts p
  WHERE NOT EXISTS (SELECT 1 FROM st_search_queries q WHERE CAST(q.id AS VARCHAR) = CAST(p.search_query_id AS VARCHAR))
UNION ALL SELECT 'content.post_id', count(*) FROM st_content c
  WHERE NOT EXISTS (SELECT 1 FROM st_posts p WHERE p.id = c.post_id)
UNION ALL SELECT 'sentiment_analyses.post_id', count(*) FROM st_sentiment_analyses a
  WHERE NOT EXISTS (SELECT 1 FROM st_posts p WHERE p.id = a.post_id)
UNION ALL SELECT 'sentiment_analyses.content_id', count(*) FROM st_sentiment_analyses a
  WHERE a.content_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM st_content c WHERE c.id = a.content_id)"""))
def fk_orphans(spark, sf):
    return ST.fk_orphans(stored(spark, sf))


@query("unique_violations", _sql("""
SELECT post_id, content_id, analysis_method, count(*) AS n FROM st_sentiment_analyses
WHERE content_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1"""))
def unique_violations(spark, sf):
    return ST.unique_violations(stored(spark, sf)["sentiment_analyses"])


@query("unique_external_ids", with_views("""
SELECT source, md5(title || selftext) AS external_id, count(*) AS n FROM posts
GROUP BY 1, 2 HAVING count(*) > 1""", "plain_posts"))
def unique_external_ids(spark, sf):
    """A12, second key: external_id is bound to the digest of the whole text, as in R2."""
    p = posts(spark, sf, golden=False)
    return ST.unique_external_ids(p.select("source", F.md5(F.concat("title", "selftext")).alias("external_id")))


@query("check_violations", _sql("""
SELECT id, post_id, fetch_success FROM st_content
WHERE NOT coalesce(CASE WHEN fetch_success THEN list_contains(json_keys(fetch_details), 'content_text')
                        ELSE list_contains(json_keys(fetch_details), 'error') END, FALSE)"""))
def check_violations(spark, sf):
    return ST.check_violations(stored(spark, sf)["content"])


def posts_json(spark, sf):
    """The read-back of the full post records, all columns."""
    return sinks.write_posts_json(scored_posts(spark, sf), sinks.output_dir(spark, "posts-json"))


@query("write_posts_json", _sql("""
SELECT id, source, title, score, claude_version, sentiment_label, title_compound FROM sp"""))
def write_posts_json(spark, sf):
    """Full post records to JSON lines and back; the file holds every column of
    :func:`scored_posts`, the query shows the ones its SQL names."""
    return posts_json(spark, sf).select("id", "source", "title", "score", "claude_version", "sentiment_label",
                                        "title_compound")


@query("write_sentiment_csv", _sql(f"""
SELECT id AS post_id, title, subreddit, source, claude_version, score, title_compound AS compound, sentiment_label,
       title_positive AS positive, title_neutral AS neutral, title_negative AS negative,
       CASE WHEN length(title || ' ' || selftext) > 100
            THEN trim(replace(substr(title || ' ' || selftext, 1, 100), chr(10), ' ')) || '...'
            ELSE trim(replace(substr(title || ' ' || selftext, 1, 100), chr(10), ' ')) END AS text_preview
FROM sp"""))
def write_sentiment_csv(spark, sf):
    """The 12-column CSV (quoted, '"' escaped) and its multi-line-safe read-back."""
    frame = sinks.sentiment_csv_frame(scored_posts(spark, sf))
    return sinks.write_sentiment_csv(frame, sinks.output_dir(spark, "sentiment-csv"))


@query("json_paths", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_paths(spark, sf):
    """A scalar JSON path out of a JSON text column."""
    e = read(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("variant_paths", _sql("""
SELECT id, CAST(json_extract_string(full_results, '$.analysis_metadata.processing_time_ms') AS BIGINT) AS processing_time_ms,
       json_extract_string(full_results, '$.extracted_features.keywords[0]') AS first_keyword,
       CAST(json_array_length(full_results, '$.extracted_features.keywords') AS INTEGER) AS n_keywords,
       json_extract_string(full_results, '$.extracted_features.topics[0].name') AS no_such_path
FROM st_sentiment_analyses"""))
def variant_paths(spark, sf):
    """X18 on stored VARIANT documents: a nested path, an array element, an array's size and a
    path that no document has (NULL)."""
    doc = "full_results"
    return stored(spark, sf)["sentiment_analyses"].select(
        "id", F.variant_get(doc, "$.analysis_metadata.processing_time_ms", "bigint").alias("processing_time_ms"),
        F.variant_get(doc, "$.extracted_features.keywords[0]", "string").alias("first_keyword"),
        F.size(F.variant_get(doc, "$.extracted_features.keywords", "array<string>")).alias("n_keywords"),
        F.variant_get(doc, "$.extracted_features.topics[0].name", "string").alias("no_such_path"))


@query("keyword_array_match", with_views(f"""
SELECT id, len(list_intersect({sql_tokens('title')}, {sql_in_list(ST.KEYWORDS).replace('(', '[').replace(')', ']')})) > 0
       AS matches_topic FROM posts""", "posts"))
def keyword_array_match(spark, sf):
    """Topic keyword array overlap with the title's words."""
    kw = F.array(*[F.lit(k) for k in ST.KEYWORDS])
    p = posts(spark, sf)
    return p.select("id", F.arrays_overlap(X.tokens_az3("title"), kw).alias("matches_topic"))


@query("daily_sentiment", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id % 3 AS topic_id, event_type AS source,
       CASE WHEN user_id % 2 = 0 THEN 'rules' ELSE 'lexicon' END AS model_name,
       count(*) FILTER (WHERE s >= 0.05) AS positive_count, count(*) FILTER (WHERE s <= -0.05) AS negative_count,
       count(*) FILTER (WHERE s > -0.05 AND s < 0.05) AS neutral_count, 
       (2 * sum(CAST(round(abs(s) * 1000000) AS BIGINT)) + count(*)) // (2 * count(*)) / 1000000 AS avg_confidence
FROM (SELECT *, greatest(-1.0, least(1.0, (value - 20) / 50)) AS s FROM events) GROUP BY ALL""")
def daily_sentiment(spark, sf):
    from chorus.streaming.daily import daily_sentiment_batch
    return daily_sentiment_batch(read(spark, sf, "events"))
