"""Ranking, quotas, filters and link projections over posts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus import vocab
from chorus.functions.text import keyword_matches, query_terms
from chorus.plans.common import small

SOURCES = {"reddit": "Reddit", "hackernews": "HackerNews"}


def filter_platform(posts: DataFrame, platform: str) -> DataFrame:
    """'all' or one source, case-insensitive; anything else is rejected."""
    p = platform.strip().lower()
    if p == "all":
        return posts
    if p not in SOURCES:
        raise ValueError(f"unknown platform {platform!r}; use all, reddit or hackernews")
    return posts.where(F.col("source") == SOURCES[p])


def source_score_stats(posts: DataFrame) -> DataFrame:
    """Per source n, mean and population std of score; std 0 becomes 1."""
    return posts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_raw"),
    ).select("source", "n", "mean_score",
             F.when(F.col("std_raw") > 0, F.col("std_raw")).otherwise(F.lit(1.0)).alias("std_score"))


def zscore(posts: DataFrame, normalized_sources=("Reddit", "HackerNews")) -> DataFrame:
    """(score - mean) / std within the post's source; other sources 0.0.

    The per-source statistics are an aggregate joined back (one row per
    source, so AQE turns it into a broadcast at run time) instead of a
    window partitioned by source, which would put each source in one task."""
    stats = source_score_stats(posts).select("source", "mean_score", "std_score")
    j = posts.join(stats, "source", "left")
    z = F.when(F.col("source").isin(list(normalized_sources)),
               (F.col("score") - F.col("mean_score")) / F.col("std_score")).otherwise(F.lit(0.0))
    return j.withColumn("normalized_score", z).drop("mean_score", "std_score")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in ``order`` (per-partition top-k, then a merge)."""
    return df.orderBy(*order).limit(k)


def with_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """1-based rank numbers on an already limited result (tiny, one task)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def per_group_quota(df: DataFrame, group: str, order: list[Column], quota: int,
                    rn: str = "rn") -> DataFrame:
    """First ``quota`` rows per group. Spark plans this as a
    window-group-limit, so each task keeps only its top ``quota`` rows per
    group before the shuffle: a hot group never moves more than that."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= quota)


def source_quota(posts: DataFrame, limit: int) -> DataFrame:
    """``limit // 2`` posts per source in arrival order."""
    return per_group_quota(posts, "source", [F.col("pos"), F.col("id")], limit // 2)


def term_quota(posts: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Per query term, the first max(2*limit // n_terms, 3) matching posts.
    Terms are a short driver-side list, exploded per row; all of them count."""
    quota = max(2 * limit // max(len(terms), 1), 3)
    txt = F.lower(F.concat(F.col("title"), F.lit(" "), F.col("selftext")))
    arr = F.array(*[F.struct(F.lit(i).alias("term_ix"), F.lit(t).alias("term")) for i, t in enumerate(terms)])
    hits = (posts.withColumn("t", F.explode(arr))
            .select("*", "t.term_ix", "t.term").drop("t")
            .where(F.instr(txt, F.col("term")) > 0))
    return per_group_quota(hits, "term_ix", [F.col("pos"), F.col("id")], quota, rn="term_rank")


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` (deterministic, unlike
    dropDuplicates). min_by aggregates partially, so a hot key is combined
    map-side before the shuffle."""
    cols = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*cols), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def rank_or_results(df: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """O3: keyword matches desc, points desc, comments desc (then id); top ``limit``."""
    km = keyword_matches("title", "selftext", terms)
    return (df.withColumn("keyword_matches", km)
            .orderBy(F.desc("keyword_matches"), F.desc("score"), F.desc("num_comments"), F.asc("id"))
            .limit(limit))


def topup_to_limit(candidates: DataFrame, limit: int, first_source: str = "Reddit") -> DataFrame:
    """Per-source quota; if short of ``limit``, append the next posts of
    ``first_source`` (not already taken) and trim to ``limit``.

    The shortfall is a scalar subquery (one global count), so no data goes
    through the driver."""
    half = limit // 2
    w = Window.partitionBy("source").orderBy(F.col("pos"), F.col("id"))
    # the shortfall is at most ``limit``, so this bound drops no wanted row and each
    # task hands on only that many rows of a source
    ranked = candidates.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= half + limit)
    taken = ranked.where(F.col("rn") <= half)
    have = taken.select(F.count(F.lit(1))).scalar()
    extra = ranked.where((F.col("source") == first_source) & (F.col("rn") > half)
                         & (F.col("rn") <= F.lit(half) + (F.lit(limit) - have)))
    return taken.unionByName(extra).drop("rn")


def eligible_urls(posts: DataFrame) -> DataFrame:
    """non-empty urls that do not start with an internal prefix of the
    post's source (broadcast rule table, anti-join on source + prefix)."""
    rules = small(posts.sparkSession, "internal_url_prefixes")
    p = posts.where(F.col("url").isNotNull() & (F.col("url") != ""))
    cond = (p["source"] == rules["source"]) & p["url"].startswith(rules["prefix"])
    return p.join(rules, cond, "left_anti")


def discussion_url(source: Column, id_: Column, subreddit: Column, url: Column) -> Column:
    """The post's discussion page."""
    return (F.when(source == "Reddit",
                   F.when(F.coalesce(id_, F.lit("")) == "", F.lit(""))
                   .otherwise(F.concat(F.lit("https://www.reddit.com/r/"), F.coalesce(subreddit, F.lit("unknown")),
                                       F.lit("/comments/"), id_, F.lit("/"))))
            .when(source == "HackerNews",
                  F.when(id_.startswith("hn_"),
                         F.concat(F.lit("https://news.ycombinator.com/item?id="), F.regexp_replace(id_, "hn_", "")))
                  .otherwise(url))
            .otherwise(url))


def absolute_permalink(permalink: Column) -> Column:
    """Prefix the host unless it already starts with http; '' stays ''."""
    return (F.when(permalink.isNull() | (permalink == ""), permalink)
            .when(permalink.startswith("http"), permalink)
            .otherwise(F.concat(F.lit("https://www.reddit.com"), permalink)))


def display_links(source: Column, url: Column, discussion: Column, permalink: Column) -> Column:
    """Ordered links shown under a post."""
    u = F.coalesce(url, F.lit(""))
    prefixes = [p for s, p in vocab.INTERNAL_URL_PREFIXES if s == "Reddit"]
    internal = reduce(or_, (u.startswith(p) for p in prefixes))
    external = (u != "") & ~internal
    perm = F.coalesce(permalink, F.lit(""))
    reddit_first = F.when(perm != "", perm).otherwise(discussion)
    reddit_internal = (F.when(perm != "", perm)
                       .when(u.startswith(prefixes[0]) & u.contains("/comments/"), u)
                       .otherwise(discussion))
    return (F.when(source == "HackerNews",
                   F.when(u != discussion, F.array(discussion, u)).otherwise(F.array(discussion)))
            .when(external, F.array(reddit_first, u))
            .otherwise(F.array(reddit_internal)))
