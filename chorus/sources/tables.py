"""Read the landed tables and bind them to the posts data model.

All bindings are pure column expressions over the given tables (see
FIXTURES.md), so the same rows can be written in SQL for the oracle
(:mod:`chorus.plans.sqlviews`).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus import vocab
from chorus.functions.text import let

EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z
N_GOLDEN = len(vocab.TOPIC_TITLES)
TITLE_CHARS = 80
_WS = r"\t\n\x0B\f\r "
TITLE_PATTERN = rf"(?s)^(.{{1,{TITLE_CHARS}}})[{_WS}]"
FIRST_WORD = rf"^[{_WS}]*[^{_WS}]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One landed table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One landed table as a file stream. A file source reads folders: a table of several files is its
    own folder, a table of one file is picked out of the folder it lies in."""
    at = os.path.join(sf_dir, f"{name}.parquet")
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    stream = spark.readStream.schema(read(spark, sf_dir, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(at)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _golden_title(doc_id: Column) -> Column:
    arr = F.array(*[F.lit(t) for t in vocab.TOPIC_TITLES])
    return F.element_at(arr, (doc_id % N_GOLDEN + 1).cast("int"))


def title_head(line: Column) -> Column:
    """The longest start of at most ``TITLE_CHARS`` characters that white space or the line's
    end follows; the first word (with the white space before it) where that is longer."""
    start = F.substr(F.concat(line, F.lit(" ")), F.lit(1), F.lit(TITLE_CHARS + 1))
    return let(F.regexp_extract(start, TITLE_PATTERN, 1),
               lambda short: F.when(short != "", short).otherwise(F.regexp_extract(line, FIRST_WORD, 0)))


def posts(spark: SparkSession, sf_dir: str, golden: bool = True,
          urls: bool = False) -> DataFrame:
    """Posts view over ``documents`` (one post per document).

    The title is the start of the first line up to the last white space at or before
    ``TITLE_CHARS`` characters (the first word if that is longer), the selftext everything
    after it: no character is lost and no word is cut. ``golden`` puts one of
    ``vocab.TOPIC_TITLES`` before the title so model/version extraction has
    something to find (word, network and whole-text queries leave it off); ``urls`` attaches page urls (a join
    with ``pages``), left out when a query does not need them.
    """
    d = read(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    reddit = doc_id % 2 == 0
    txt = F.coalesce(F.col("text"), F.lit(""))
    first_line = F.substring_index(txt, "\n", 1)
    d = d.withColumn("_head", title_head(first_line))  # a column: both its readers find it computed
    head = F.col("_head")
    g = _golden_title(doc_id) if golden else F.lit("")
    sid = doc_id.cast("string")
    cols = [
        F.when(reddit, sid).otherwise(F.concat(F.lit("hn_"), sid)).alias("id"),
        F.when(reddit, F.lit("Reddit")).otherwise(F.lit("HackerNews")).alias("source"),
        F.when(reddit, F.col("source")).otherwise(F.lit("HackerNews")).alias("subreddit"),
        F.when(g == "", head).otherwise(F.concat(g, F.lit(" "), head)).alias("title"),
        F.substr(txt, F.length(head) + 1).alias("selftext"),  # all that the title does not hold
        F.col("n_chars").alias("score"),
        (doc_id % 37).alias("num_comments"),
        (F.lit(EPOCH_2024) + (doc_id * 7919) % 2592000).alias("created_epoch"),
        F.when(reddit & (doc_id % 4 == 0),
               F.concat(F.lit("/r/"), F.col("source"), F.lit("/comments/"), sid, F.lit("/")))
        .when(reddit, F.lit("")).alias("permalink"),
        F.concat(F.lit("user"), (doc_id % 101).cast("string")).alias("author"),
        doc_id.alias("pos"),
    ]
    out = d.select(*cols, doc_id)
    if urls:
        pages = read(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url").alias("page_url"))
        out = out.join(pages, out.pos == pages.page_id, "left")  # the texts stay dealt by pos
        url = (F.when(F.col("doc_id") % 7 == 0, F.lit(""))
               .when(F.col("doc_id") % 7 == 1,
                     F.when(F.col("source") == "Reddit",
                            F.concat(F.lit("https://i.redd.it/"), F.col("doc_id").cast("string"), F.lit(".jpg")))
                     .otherwise(F.concat(F.lit("https://news.ycombinator.com/item?id="),
                                         F.col("doc_id").cast("string"))))
               .otherwise(F.coalesce(F.col("page_url"), F.lit(""))))
        out = out.withColumn("url", url).drop("page_id", "page_url")
    return out.drop("doc_id")


def threads(spark: SparkSession, sf_dir: str, tombstones: bool = True) -> DataFrame:
    """Comment threads bound to ``conversations``: each user turn is a
    top-level comment, the assistant turn right after it is its reply.
    Some texts become tombstones (``[deleted]``, ``[removed]``, blank) by
    ``(conv_id + turn) % 11``. One row per comment:
    (post_id, thread_ix, reply_ix, text); reply_ix = 0 marks the top comment.
    Without ``tombstones`` every text is kept as it is, and a system turn opens
    a thread of its own.
    """
    c = read(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 11
    text = (F.when(k == 3, F.lit("[deleted]")).when(k == 5, F.lit("[removed]"))
            .when(k == 7, F.lit("  ")).otherwise(F.col("text")))
    # a user turn opens thread number `turn`; the assistant turn turn+1 replies to it
    is_user = F.col("role") != "assistant"
    if tombstones:
        c = c.where(F.col("role") != "system")
    else:
        text = F.col("text")
    return c.select(
        F.col("conv_id").alias("post_id"),
        F.when(is_user, F.col("turn")).otherwise(F.col("turn") - 1).alias("thread_ix"),
        F.when(is_user, F.lit(0)).otherwise(F.lit(1)).alias("reply_ix"),
        text.alias("text"),
    )
