"""Landed JSON: the two forums' listing / hits / comment / item documents.

Readers take what the public APIs return, stored as JSON lines, with an
explicit schema (no inference). ``land_*`` functions write such documents
from the test tables, so the readers have input that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOMBSTONES = ["[deleted]", "[removed]"]

LISTING_SCHEMA = """kind string, data struct<after string, children array<struct<kind string, data struct<
  id string, title string, selftext string, score bigint, url string, author string, created_utc bigint,
  num_comments bigint, subreddit string, permalink string>>>>"""

HIT_SCHEMA = """objectID string, title string, story_text string, points bigint, url string, author string,
  created_at_i bigint, num_comments bigint"""

COMMENT_LISTING_SCHEMA = """post_id string, listing array<struct<kind string, data struct<children array<struct<
  kind string, data struct<body string, replies struct<data struct<children array<struct<kind string,
  data struct<body string>>>>>>>>>>>"""

ITEM_SCHEMA = "id bigint, post_id string, kids array<bigint>, text string, deleted boolean, dead boolean"
COMMENT_HITS_SCHEMA = "post_id string, hits array<struct<comment_text string>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ------------------------------------------------------------------ posts
def ingest_listing_posts(listing: DataFrame, seen_ids: DataFrame | None = None) -> DataFrame:
    """Explode data.children (every child a document holds), keep kind t3 with a title, drop ids already seen (J2, anti-join), defaults
    for missing fields; the permalink is made absolute (P2)."""
    ch = listing_children(listing.select(F.explode(F.col("data.children")).alias("c")))
    if seen_ids is not None:
        ch = ch.join(seen_ids.select("id"), "id", "left_anti")
    return listing_posts(ch)


def listing_children(children: DataFrame) -> DataFrame:
    """The posts among listing children ``c``: kind t3 with a title."""
    return children.where((F.col("c.kind") == "t3") & (F.coalesce(F.col("c.data.title"), F.lit("")) != "")).select("c.data.*")


def listing_posts(ch: DataFrame) -> DataFrame:
    """Post records of listing children, defaults for missing fields."""
    perm = F.coalesce(F.col("permalink"), F.lit(""))
    return ch.select(
        "id", "title", F.coalesce("selftext", F.lit("")).alias("selftext"), F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("url", F.lit("")).alias("url"), F.coalesce("author", F.lit("[deleted]")).alias("author"),
        F.coalesce("created_utc", F.lit(0)).alias("created_epoch"),
        F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
        F.coalesce("subreddit", F.lit("unknown")).alias("subreddit"),
        F.when((perm != "") & ~perm.startswith("http"), F.concat(F.lit("https://www.reddit.com"), perm))
        .otherwise(perm).alias("permalink"),
        F.lit("Reddit").alias("source"))


def ingest_hits_posts(lines: DataFrame) -> DataFrame:
    """Hits documents read as text; each hit is parsed from its own JSON
    text so that an absent ``url`` key (-> discussion page) differs from a
    present null (kept NULL)."""
    return hit_posts(lines.select(F.explode(F.from_json("value", "struct<hits: array<string>>")["hits"]).alias("h")))


def hit_posts(hits: DataFrame) -> DataFrame:
    """Post records of hits ``h``, each a JSON text."""
    h = hits.select(F.from_json("h", HIT_SCHEMA).alias("x"), F.json_object_keys("h").alias("keys")) \
        .where(F.coalesce(F.col("x.title"), F.lit("")) != "")
    oid = F.coalesce(F.col("x.objectID"), F.lit(""))
    return h.select(
        F.concat(F.lit("hn_"), oid).alias("id"), F.col("x.title").alias("title"),
        F.coalesce("x.story_text", F.lit("")).alias("selftext"), F.coalesce("x.points", F.lit(0)).alias("score"),
        F.when(F.array_contains("keys", "url"), F.col("x.url"))
        .otherwise(F.concat(F.lit("https://news.ycombinator.com/item?id="), oid)).alias("url"),
        F.coalesce("x.author", F.lit("[deleted]")).alias("author"),
        F.coalesce("x.created_at_i", F.lit(0)).alias("created_epoch"),
        F.coalesce("x.num_comments", F.lit(0)).alias("num_comments"),
        F.lit("HackerNews").alias("subreddit"), F.lit("HackerNews").alias("source"))


# ---------------------------------------------------------------- comments
def _alive_body(b):
    return b.isNotNull() & (b != "") & ~b.isin(TOMBSTONES)


def listing_threads(docs: DataFrame, limit: int = 30) -> DataFrame:
    """Comment listing [post, comments]: top-level t1 comments that are
    not tombstones; the first 2 reply children are taken before the same
    filters; at most ``limit`` kept threads per post, in listing order.
    Rows: (post_id, thread_ix, reply_ix, text), reply_ix 0 = the comment."""
    top = docs.select("post_id", F.posexplode(F.element_at("listing", 2)["data"]["children"]).alias("ix", "c")) \
        .where((F.col("c.kind") == "t1") & _alive_body(F.col("c.data.body")))
    w = Window.partitionBy("post_id").orderBy("ix")
    top = top.withColumn("thread_ix", F.row_number().over(w) - 1).where(F.col("thread_ix") < limit)
    replies = F.filter(F.slice(F.col("c.data.replies.data.children"), 1, 2),
                       lambda r: (r["kind"] == "t1") & _alive_body(r["data"]["body"]))
    reply_texts = F.coalesce(F.transform(replies, lambda r: r["data"]["body"]), F.array().cast("array<string>"))
    rows = top.select("post_id", "thread_ix", F.concat(F.array(F.col("c.data.body")), reply_texts).alias("texts"))
    return rows.select("post_id", "thread_ix", F.posexplode("texts").alias("reply_ix", "text"))


def flat_listing_comments(docs: DataFrame, limit: int = 30) -> DataFrame:
    """S6 (listing source): non-tombstone top-level t1 bodies, first ``limit`` kept."""
    t = listing_threads(docs, limit)
    return t.where(F.col("reply_ix") == 0).select("post_id", F.col("thread_ix").alias("ix"), "text")


def flat_hit_comments(docs: DataFrame, limit: int = 30) -> DataFrame:
    """S6 (hits source): the first ``limit`` hits, non-blank comment_text kept."""
    h = docs.select("post_id", F.posexplode(F.slice("hits", 1, limit)).alias("ix", "h")) \
        .where(F.col("h.comment_text").isNotNull() & (F.trim("h.comment_text") != ""))
    w = Window.partitionBy("post_id").orderBy("ix")
    return h.select("post_id", (F.row_number().over(w) - 1).alias("ix"), F.col("h.comment_text").alias("text"))


def item_threads(items: DataFrame, limit: int = 30) -> DataFrame:
    """Items keyed by id. Story kids are sliced to the first ``limit``
    before filtering; deleted/dead/blank comments dropped; each comment's
    first 2 kids sliced before the same filter. Kids are resolved by
    equi-joins on the item id (two levels)."""
    alive = (~F.coalesce(F.col("deleted"), F.lit(False)) & ~F.coalesce(F.col("dead"), F.lit(False))
             & F.col("text").isNotNull() & (F.trim("text") != ""))
    it = items.select("id", "kids", "text", alive.alias("alive"))
    stories = items.where(F.col("post_id").isNotNull()).select(
        "post_id", F.posexplode(F.slice("kids", 1, limit)).alias("k_ix", "cid"))
    top = stories.join(it.select(F.col("id").alias("cid"), "kids", "text", "alive"), "cid").where("alive")
    w = Window.partitionBy("post_id").orderBy("k_ix")
    top = top.withColumn("thread_ix", F.row_number().over(w) - 1)
    reps = top.select("post_id", "thread_ix", F.posexplode(F.slice("kids", 1, 2)).alias("r_ix", "rid")) \
        .join(it.select(F.col("id").alias("rid"), "text", "alive"), "rid").where("alive")
    rw = Window.partitionBy("post_id", "thread_ix").orderBy("r_ix")
    reps = reps.select("post_id", "thread_ix", F.row_number().over(rw).alias("reply_ix"), "text")
    return top.select("post_id", "thread_ix", F.lit(0).alias("reply_ix"), "text").unionByName(reps)


# ----------------------------------------------------- landing (test input)
def land_listings(posts: DataFrame, path: str) -> None:
    """Reddit listing pages of 100 posts, some children of other kinds,
    blank titles and missing fields."""
    r = posts.where(F.col("source") == "Reddit")
    p = F.col("pos")
    child = F.struct(
        F.when(p % 23 == 0, F.lit("t1")).otherwise(F.lit("t3")).alias("kind"),
        F.struct("id", F.when(p % 58 == 0, F.lit("")).otherwise(F.col("title")).alias("title"),
                 F.when(F.col("selftext") == "", F.lit(None).cast("string")).otherwise(F.col("selftext")).alias("selftext"),
                 "score", "url", F.when(p % 31 == 0, F.lit(None).cast("string")).otherwise(F.col("author")).alias("author"),
                 F.col("created_epoch").alias("created_utc"), "num_comments",
                 F.when(p % 41 == 0, F.lit(None).cast("string")).otherwise(F.col("subreddit")).alias("subreddit"),
                 "permalink").alias("data"))
    pages = r.groupBy((p / 200).cast("long").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct(p.alias("o"), child.alias("c")))).alias("cs"))
    pages.select(F.lit("Listing").alias("kind"),
                 F.struct(F.lit(None).cast("string").alias("after"),
                          F.transform("cs", lambda x: x["c"]).alias("children")).alias("data")) \
        .write.mode("overwrite").json(path)


def land_hits(posts: DataFrame, path: str) -> None:
    """Hits pages; ``url`` absent for empty urls, present-but-null for pos % 11 == 3."""
    h = posts.where(F.col("source") == "HackerNews")
    p = F.col("pos")
    oid = F.regexp_replace("id", "^hn_", "")
    base = [oid.alias("objectID"), "title",
            F.when(F.col("selftext") == "", F.lit(None).cast("string")).otherwise(F.col("selftext")).alias("story_text"),
            F.col("score").alias("points")]
    rest = [F.col("author"), F.col("created_epoch").alias("created_at_i"), "num_comments"]
    with_null = F.to_json(F.struct(*base, F.lit(None).cast("string").alias("url"), *rest),
                          {"ignoreNullFields": "false"})
    normal = F.to_json(F.struct(*base, F.nullif(F.col("url"), F.lit("")).alias("url"), *rest))
    hit = F.when(p % 11 == 3, with_null).otherwise(normal)
    pages = h.groupBy((p / 200).cast("long").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct(p.alias("o"), hit.alias("j")))).alias("hs"))
    pages.select(F.concat(F.lit('{"hits":['), F.array_join(F.transform("hs", lambda x: x["j"]), ","),
                          F.lit("]}")).alias("value")).write.mode("overwrite").text(path)


def land_comment_listings(threads: DataFrame, path: str) -> None:
    """Reddit comment documents [post, comments] for even conversation ids;
    a top-level child becomes kind 'more' when (post + thread) % 9 == 0."""
    t = threads.where(F.col("post_id") % 2 == 0)
    top = t.where(F.col("reply_ix") == 0).alias("t")
    rep = t.where(F.col("reply_ix") == 1).select("post_id", "thread_ix", F.col("text").alias("reply")).alias("r")
    j = top.join(rep, ["post_id", "thread_ix"], "left")
    reply_children = F.when(F.col("reply").isNotNull(), F.struct(F.struct(F.array(F.struct(
        F.lit("t1").alias("kind"), F.struct(F.col("reply").alias("body")).alias("data")))
        .alias("children")).alias("data")))
    child = F.struct(F.when((F.col("post_id") + F.col("thread_ix")) % 9 == 0, F.lit("more")).otherwise(F.lit("t1"))
                     .alias("kind"), F.struct(F.col("text").alias("body"), reply_children.alias("replies")).alias("data"))
    docs = j.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("thread_ix", child.alias("c")))).alias("cs"))
    empty = F.struct(F.lit("Listing").alias("kind"),
                     F.struct(F.filter(F.transform("cs", lambda x: x["c"]), lambda x: F.lit(False)).alias("children"))
                     .alias("data"))
    comments = F.struct(F.lit("Listing").alias("kind"),
                        F.struct(F.transform("cs", lambda x: x["c"]).alias("children")).alias("data"))
    docs.select(F.col("post_id").cast("string").alias("post_id"), F.array(empty, comments).alias("listing")) \
        .write.mode("overwrite").json(path)


def land_items(threads: DataFrame, path: str) -> None:
    """HN items for odd conversation ids: a story with kids, comments
    (deleted / dead flags for tombstones) and their replies."""
    t = threads.where(F.col("post_id") % 2 == 1)
    # ids of their own for up to half a million threads a post: the comment's, and next to it its reply's
    cid = F.lit(1_000_000_000) + F.col("post_id").cast("long") * 1_000_000 + 2 * F.col("thread_ix")
    top = t.where(F.col("reply_ix") == 0)
    rep = t.where(F.col("reply_ix") == 1).select("post_id", "thread_ix", F.col("text").alias("reply"))
    j = top.join(rep, ["post_id", "thread_ix"], "left")
    flags = lambda x: [(x == "[deleted]").alias("deleted"), (x == "[removed]").alias("dead")]
    comments = j.select(cid.alias("id"), F.lit(None).cast("string").alias("post_id"),
                        F.when(F.col("reply").isNotNull(), F.array(cid + 1)).alias("kids"), "text", *flags(F.col("text")))
    replies = j.where(F.col("reply").isNotNull()).select(
        (cid + 1).alias("id"), F.lit(None).cast("string").alias("post_id"), F.lit(None).cast("array<bigint>").alias("kids"),
        F.col("reply").alias("text"), *flags(F.col("reply")))
    stories = top.groupBy("post_id").agg(F.array_sort(F.collect_list(cid)).alias("kids")).select(
        F.col("post_id").cast("long").alias("id"), F.concat(F.lit("hn_"), F.col("post_id").cast("string")).alias("post_id"),
        "kids", F.lit(None).cast("string").alias("text"), F.lit(False).alias("deleted"), F.lit(False).alias("dead"))
    stories.unionByName(comments).unionByName(replies).write.mode("overwrite").json(path)


def land_comment_hits(threads: DataFrame, path: str) -> None:
    """Comment search hits for odd conversation ids (one page per post)."""
    t = threads.where((F.col("post_id") % 2 == 1))
    docs = t.groupBy("post_id").agg(F.array_sort(F.collect_list(
        F.struct("thread_ix", "reply_ix", F.col("text").alias("comment_text")))).alias("hs"))
    docs.select(F.concat(F.lit("hn_"), F.col("post_id").cast("string")).alias("post_id"),
                F.transform("hs", lambda x: F.struct(x["comment_text"].alias("comment_text"))).alias("hits")) \
        .write.mode("overwrite").json(path)
