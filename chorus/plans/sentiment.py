"""Sentiment queries over posts and comment threads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chorus.functions import text as X
from chorus.operators.sentiment import sentiment_scores
from chorus.plans.catalog import query
from chorus.plans.sentiment_sql import sentiment_ctes
from chorus.plans.sqlviews import with_views
from chorus.sources.tables import posts, threads


def _sent_views(src_sql: str, *views: str, more: dict | None = None):
    extra = {"sent_in": src_sql}
    extra.update(sentiment_ctes())
    extra.update(more or {})
    return lambda sql: with_views(sql, *views, extra=extra)


_WHOLE = _sent_views("SELECT id AS sid, title || selftext AS text FROM posts", "plain_posts")
_TITLE = _sent_views("SELECT id AS sid, title AS text FROM posts", "plain_posts")


def title_scores(spark, sf):
    """T1 on the titles of the documents themselves, without injected ones."""
    p = posts(spark, sf, golden=False)
    return sentiment_scores(p.select("id", "title"), "id", "title")


@query("sentiment_scores", _WHOLE("""
SELECT sid AS id, compound, positive, neutral, negative FROM sent_out"""))
def q_sentiment_scores(spark, sf):
    """T1 on the whole text of every document."""
    p = posts(spark, sf, golden=False).select("id", F.concat("title", "selftext").alias("text"))
    return sentiment_scores(p, "id", "text")


_LABEL_SQL = "CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END"


@query("sentiment_label", _TITLE(f"SELECT sid AS id, compound, {_LABEL_SQL} AS sentiment_label FROM sent_out"))
def q_sentiment_label(spark, sf):
    return title_scores(spark, sf).select("id", "compound", X.sentiment_label("compound").alias("sentiment_label"))


_SUMMARY_SQL = f"""
  SELECT count(*) AS n_posts, round(avg(compound), 6) AS avg_sentiment,
         count(*) FILTER (WHERE {_LABEL_SQL} = 'positive') AS n_positive,
         count(*) FILTER (WHERE {_LABEL_SQL} = 'neutral') AS n_neutral,
         count(*) FILTER (WHERE {_LABEL_SQL} = 'negative') AS n_negative,
         round(100.0 * count(*) FILTER (WHERE {_LABEL_SQL} = 'positive') / count(*), 6) AS pct_positive,
         round(100.0 * count(*) FILTER (WHERE {_LABEL_SQL} = 'neutral') / count(*), 6) AS pct_neutral,
         round(100.0 * count(*) FILTER (WHERE {_LABEL_SQL} = 'negative') / count(*), 6) AS pct_negative
  FROM sent_out HAVING count(*) > 0"""


def summary(scores):
    """A1: one global aggregate (partial per task, then one final row); empty input gives no row."""
    lab = X.sentiment_label("compound")
    n = F.count(F.lit(1))
    return scores.agg(
        n.alias("n_posts"), F.round(F.avg("compound"), 6).alias("avg_sentiment"),
        F.count_if(lab == "positive").alias("n_positive"), F.count_if(lab == "neutral").alias("n_neutral"),
        F.count_if(lab == "negative").alias("n_negative"),
        F.round(100.0 * F.count_if(lab == "positive") / n, 6).alias("pct_positive"),
        F.round(100.0 * F.count_if(lab == "neutral") / n, 6).alias("pct_neutral"),
        F.round(100.0 * F.count_if(lab == "negative") / n, 6).alias("pct_negative"),
    ).where(F.col("n_posts") > 0)


@query("sentiment_summary", _TITLE(_SUMMARY_SQL))
def q_sentiment_summary(spark, sf):
    return summary(title_scores(spark, sf))


@query("summary_mood", _TITLE(f"""
SELECT n_posts, avg_sentiment, CASE WHEN avg_sentiment > 0.1 THEN 'positive' WHEN avg_sentiment < -0.1 THEN 'negative'
       ELSE 'neutral' END AS mood FROM ({_SUMMARY_SQL})"""))
def q_summary_mood(spark, sf):
    s = summary(title_scores(spark, sf))
    a = F.col("avg_sentiment")
    return s.select("n_posts", "avg_sentiment",
                    F.when(a > 0.1, "positive").when(a < -0.1, "negative").otherwise("neutral").alias("mood"))


@query("posts_by_sentiment", _TITLE("SELECT sid AS id, compound FROM sent_out ORDER BY compound DESC, id"))
def q_posts_by_sentiment(spark, sf):
    return title_scores(spark, sf).select("id", "compound").orderBy(F.desc("compound"), F.asc("id"))


@query("top_bottom_k", _TITLE("""
SELECT DISTINCT id, compound FROM (
  (SELECT sid AS id, compound FROM sent_out ORDER BY compound DESC, sid LIMIT 5)
  UNION ALL
  (SELECT sid AS id, compound FROM sent_out ORDER BY compound ASC, sid DESC LIMIT 5))"""))
def q_top_bottom_k(spark, sf):
    """First 5 and last 5 by title compound; overlap listed once."""
    s = title_scores(spark, sf).select("id", "compound")
    top = s.orderBy(F.desc("compound"), F.asc("id")).limit(5)
    bottom = s.orderBy(F.asc("compound"), F.desc("id")).limit(5)
    return top.unionByName(bottom).distinct()


_P5 = _sent_views("SELECT id AS sid, title AS text FROM posts UNION ALL "
                  "SELECT 'S' || id AS sid, selftext AS text FROM posts WHERE selftext <> ''", "posts")


@query("result_projection", _P5(f"""
SELECT p.id, p.source, t.compound AS title_compound, s.compound AS selftext_compound,
       CASE WHEN t.compound >= 0.05 THEN 'positive' WHEN t.compound <= -0.05 THEN 'negative' ELSE 'neutral' END
         AS sentiment_label
FROM posts p JOIN sent_out t ON t.sid = p.id LEFT JOIN sent_out s ON s.sid = 'S' || p.id"""))
def q_result_projection(spark, sf):
    """P5: result row per post: title sentiment, selftext sentiment (NULL for an empty selftext) and
    the label, which comes from the title. Both texts go through T1 together."""
    part = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("title").alias("text")),
                             F.struct(F.lit(1).alias("part"), F.nullif(F.col("selftext"), F.lit("")).alias("text")))).alias("p")
    texts = posts(spark, sf).select("id", "source", part).select("id", "source", "p.*").where("part = 0 OR text IS NOT NULL")
    s = sentiment_scores(texts, ["id", "source", "part"], "text")
    both = s.groupBy("id", "source").agg(F.max(F.when(F.col("part") == 0, F.col("compound"))).alias("title_compound"),
                                         F.max(F.when(F.col("part") == 1, F.col("compound"))).alias("selftext_compound"))
    return both.select("id", "source", "title_compound", "selftext_compound",
                       X.sentiment_label("title_compound").alias("sentiment_label"))


# ---------------------------------------------------------------- threads
_THR = _sent_views(
    "SELECT CAST(post_id AS VARCHAR) || ':' || CAST(thread_ix AS VARCHAR) || ':' || CAST(reply_ix AS VARCHAR) AS sid, "
    "text FROM threads", "plain_threads",
    more={"thr": """SELECT t.post_id, t.thread_ix, t.reply_ix, t.text, s.compound FROM threads t JOIN sent_out s
                    ON s.sid = CAST(t.post_id AS VARCHAR) || ':' || CAST(t.thread_ix AS VARCHAR) || ':'
                               || CAST(t.reply_ix AS VARCHAR)""",
          "kept": """SELECT r.* FROM thr r JOIN thr top ON top.post_id = r.post_id AND top.thread_ix = r.thread_ix
                     AND top.reply_ix = 0 AND top.text IS NOT NULL AND trim(top.text) <> ''
                     WHERE r.text IS NOT NULL AND trim(r.text) <> ''"""})


def kept_thread_comments(spark, sf):
    """Threads with a non-blank top comment, non-blank replies only: (post_id, thread_ix,
    reply_ix, bucket, compound). Threads are chosen before anything is scored, and the length
    bucket goes through T1 with the key, so that scores are not joined back to texts."""
    t = threads(spark, sf, tombstones=False).where(F.col("text").isNotNull() & (F.trim("text") != ""))
    tops = t.where(F.col("reply_ix") == 0).select("post_id", "thread_ix")
    kept = t.join(tops, ["post_id", "thread_ix"], "left_semi").withColumn("bucket", X.length_bucket("text"))
    return sentiment_scores(kept, ["post_id", "thread_ix", "reply_ix", "bucket"], "text")


@query("thread_sentiments", _THR("SELECT post_id, thread_ix, reply_ix, compound FROM kept"))
def q_thread_sentiments(spark, sf):
    return kept_thread_comments(spark, sf).select("post_id", "thread_ix", "reply_ix", "compound")


_A3_SQL = """
  SELECT p.id, c.n_positive, c.n_neutral, c.n_negative FROM posts p LEFT JOIN (
    SELECT post_id,
           count(*) FILTER (WHERE compound >= 0.05) AS n_positive,
           count(*) FILTER (WHERE compound > -0.05 AND compound < 0.05) AS n_neutral,
           count(*) FILTER (WHERE compound <= -0.05) AS n_negative
    FROM kept WHERE reply_ix = 0 GROUP BY post_id) c
  ON p.id = CASE WHEN c.post_id % 2 = 0 THEN CAST(c.post_id AS VARCHAR) ELSE 'hn_' || CAST(c.post_id AS VARCHAR) END"""


def comment_label_counts(spark, sf):
    """A3: per post, label counts over non-blank top-level comments; NULL when the post has no thread."""
    k = kept_thread_comments(spark, sf).where(F.col("reply_ix") == 0)
    lab = X.sentiment_label("compound")
    c = k.groupBy("post_id").agg(F.count_if(lab == "positive").alias("n_positive"),
                                 F.count_if(lab == "neutral").alias("n_neutral"),
                                 F.count_if(lab == "negative").alias("n_negative"))
    pid = F.when(F.col("post_id") % 2 == 0, F.col("post_id").cast("string")) \
        .otherwise(F.concat(F.lit("hn_"), F.col("post_id").cast("string")))
    c = c.select(pid.alias("id"), "n_positive", "n_neutral", "n_negative")
    return posts(spark, sf).select("id").join(c, "id", "left")


_THR_A3 = _sent_views(
    "SELECT CAST(post_id AS VARCHAR) || ':' || CAST(thread_ix AS VARCHAR) || ':' || CAST(reply_ix AS VARCHAR) AS sid, "
    "text FROM threads", "plain_threads", "posts",
    more={"thr": """SELECT t.post_id, t.thread_ix, t.reply_ix, t.text, s.compound FROM threads t JOIN sent_out s
                    ON s.sid = CAST(t.post_id AS VARCHAR) || ':' || CAST(t.thread_ix AS VARCHAR) || ':'
                               || CAST(t.reply_ix AS VARCHAR)""",
          "kept": """SELECT r.* FROM thr r JOIN thr top ON top.post_id = r.post_id AND top.thread_ix = r.thread_ix
                     AND top.reply_ix = 0 AND top.text IS NOT NULL AND trim(top.text) <> ''
                     WHERE r.text IS NOT NULL AND trim(r.text) <> ''"""})


@query("comment_label_counts", _THR_A3(_A3_SQL))
def q_comment_label_counts(spark, sf):
    return comment_label_counts(spark, sf)


@query("five_block_share", _THR_A3(f"""
SELECT id, CASE WHEN pb >= ub AND pb >= nb THEN pb + 5 - (pb + ub + nb) ELSE pb END AS pos_blocks,
           CASE WHEN NOT (pb >= ub AND pb >= nb) AND ub >= pb AND ub >= nb THEN ub + 5 - (pb + ub + nb) ELSE ub END
             AS neu_blocks,
           CASE WHEN NOT (pb >= ub AND pb >= nb) AND NOT (ub >= pb AND ub >= nb) THEN nb + 5 - (pb + ub + nb) ELSE nb END
             AS neg_blocks
FROM (SELECT id, CAST(round_even(n_positive * 5.0 / (n_positive + n_neutral + n_negative), 0) AS INTEGER) AS pb,
             CAST(round_even(n_neutral * 5.0 / (n_positive + n_neutral + n_negative), 0) AS INTEGER) AS ub,
             CAST(round_even(n_negative * 5.0 / (n_positive + n_neutral + n_negative), 0) AS INTEGER) AS nb
      FROM ({_A3_SQL}) WHERE n_positive + n_neutral + n_negative > 0)"""))
def q_five_block_share(spark, sf):
    c = comment_label_counts(spark, sf)
    b = X.five_blocks(F.col("n_positive"), F.col("n_neutral"), F.col("n_negative"))
    return c.select("id", b.alias("b")).where(F.col("b").isNotNull()).select("id", "b.*")


_STRIP_SQL = """
SELECT post_id, line, cell, cls, bucket FROM (
  SELECT post_id, 1 AS line, cursor AS cell, cls, bucket, cursor FROM tops
  UNION ALL
  SELECT r.post_id, 2 AS line, t.cursor + r.rr AS cell, r.cls, r.bucket, t.cursor
  FROM reps r JOIN tops t ON r.post_id = t.post_id AND r.thread_ix = t.thread_ix)
WHERE cursor < 8 AND cell < 8"""
_CLS = "CASE WHEN compound > 0.05 THEN 'positive' WHEN compound < -0.05 THEN 'negative' ELSE 'neutral' END"
_BUCKET = ("CASE WHEN length(text) = 0 THEN 0 WHEN length(text) < 50 THEN 1 WHEN length(text) < 100 THEN 2 "
           "WHEN length(text) < 200 THEN 3 WHEN length(text) < 400 THEN 4 WHEN length(text) < 600 THEN 5 "
           "WHEN length(text) < 800 THEN 6 ELSE 7 END")
_THR_STRIP = _sent_views(
    "SELECT CAST(post_id AS VARCHAR) || ':' || CAST(thread_ix AS VARCHAR) || ':' || CAST(reply_ix AS VARCHAR) AS sid, "
    "text FROM threads", "plain_threads",
    more={"thr": """SELECT t.post_id, t.thread_ix, t.reply_ix, t.text, s.compound FROM threads t JOIN sent_out s
                    ON s.sid = CAST(t.post_id AS VARCHAR) || ':' || CAST(t.thread_ix AS VARCHAR) || ':'
                               || CAST(t.reply_ix AS VARCHAR)""",
          "kept": """SELECT r.* FROM thr r JOIN thr top ON top.post_id = r.post_id AND top.thread_ix = r.thread_ix
                     AND top.reply_ix = 0 AND top.text IS NOT NULL AND trim(top.text) <> ''
                     WHERE r.text IS NOT NULL AND trim(r.text) <> ''""",
          "reps": f"""SELECT * FROM (SELECT post_id, thread_ix, {_CLS} AS cls, {_BUCKET} AS bucket,
                        row_number() OVER (PARTITION BY post_id, thread_ix ORDER BY reply_ix) AS rr
                      FROM kept WHERE reply_ix > 0) WHERE rr <= 2""",
          "tops": f"""SELECT k.post_id, k.thread_ix, {_CLS} AS cls, {_BUCKET} AS bucket,
                        CAST(coalesce(sum(1 + coalesce(c.nr, 0)) OVER (PARTITION BY k.post_id ORDER BY k.thread_ix
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cursor
                      FROM kept k LEFT JOIN (SELECT post_id, thread_ix, count(*) AS nr FROM reps GROUP BY 1, 2) c
                        ON k.post_id = c.post_id AND k.thread_ix = c.thread_ix
                      WHERE k.reply_ix = 0"""})


@query("thread_strip", _THR_STRIP(_STRIP_SQL))
def q_thread_strip(spark, sf):
    """The 8-cell strip per post. cursor = running sum of 1 + min(replies, 2) over earlier
    threads; a thread is drawn while cursor < 8, its replies at cursor+1.. while < 8. Cell =
    class (X7) + length bucket (X9). Every thread takes a cell, so the first 8 of a post
    are enough: each is one row with its replies before the window over them."""
    cell = F.struct("reply_ix", X.strip_class("compound").alias("cls"), "bucket")
    per = kept_thread_comments(spark, sf).groupBy("post_id", "thread_ix").agg(
        F.array_sort(F.collect_list(cell)).alias("cells"))
    per = per.select("post_id", "thread_ix", F.slice("cells", 1, 3).alias("cells"))  # the comment and two replies
    w = Window.partitionBy("post_id").orderBy("thread_ix")
    first = per.withColumn("k", F.row_number().over(w)).where(F.col("k") <= 8)
    before = F.sum(F.size("cells")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    drawn = first.withColumn("cursor", F.coalesce(before, F.lit(0))).where(F.col("cursor") < 8)
    out = drawn.select("post_id", "cursor", F.posexplode("cells").alias("i", "c"))
    return out.where(F.col("cursor") + F.col("i") < 8).select(
        "post_id", F.when(F.col("i") == 0, 1).otherwise(2).alias("line"), (F.col("cursor") + F.col("i")).alias("cell"),
        F.col("c.cls").alias("cls"), F.col("c.bucket").alias("bucket"))


@query("lexicon_join", _WHOLE("""
SELECT t.sid AS id, count(*) AS n_hits, round(sum(x.valence), 6) AS sum_valence
FROM s_tok t JOIN lex x ON t.tok = x.token GROUP BY t.sid"""))
def q_lexicon_join(spark, sf):
    """The tokens of whole texts (as T1 splits them) joined to the broadcast lexicon."""
    from chorus.operators.sentiment import lexicon_for_join, token_rows
    rows = token_rows(posts(spark, sf, golden=False).select("id", F.concat("title", "selftext").alias("text")),
                      ["id"], "text").where(F.col("i") >= 0)
    lex, _ = lexicon_for_join(spark, None)
    j = rows.join(lex, rows.tok == lex.token)
    return j.groupBy(F.col("sid.id").alias("id")).agg(F.count(F.lit(1)).alias("n_hits"),
                                                      F.round(F.sum("valence"), 6).alias("sum_valence"))
