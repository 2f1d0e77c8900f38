"""Result store: four tables derived from analysed posts, and checks on them.

Tables (column types follow the documented schema): search_queries, posts,
content and sentiment_analyses. JSON documents are VARIANT columns in the store
(:mod:`chorus.sources.store`), read with ``variant_get``. The constraints the reference
declares but does not always create (FKs, UNIQUE, CHECK) are verified on data (A12, A13, J5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYWORDS = ["claude", "sonnet", "opus", "haiku", "gpt", "gemini"]


def decimal_4_3(x) -> F.Column:
    """Numeric(4,3); the double is first taken at its 4-decimal value,
    then rounded half-up, as a database does with a float parameter."""
    return x.cast("decimal(10,4)").cast("decimal(4,3)")


def run_stats(posts_scored: DataFrame) -> DataFrame:
    """Per run: total, per-source counts and mean title compound as decimal(4,3)."""
    return posts_scored.groupBy("search_query_id").agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.count_if(F.col("source") == "Reddit").alias("reddit_posts"),
        F.count_if(F.col("source") == "HackerNews").alias("hackernews_posts"),
        decimal_4_3(F.avg("title_compound")).alias("avg_sentiment"))


def fk_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that break each foreign key (left anti-joins), as counts."""
    sq, po, co, sa = (tables[k] for k in ("search_queries", "posts", "content", "sentiment_analyses"))
    checks = [
        ("posts.search_query_id", po.select(F.col("search_query_id").alias("k")),
         sq.select(F.col("id").alias("k"))),
        ("content.post_id", co.select(F.col("post_id").alias("k")), po.select(F.col("id").alias("k"))),
        ("sentiment_analyses.post_id", sa.select(F.col("post_id").alias("k")), po.select(F.col("id").alias("k"))),
        ("sentiment_analyses.content_id", sa.where(F.col("content_id").isNotNull()).select(F.col("content_id").alias("k")),
         co.select(F.col("id").alias("k"))),
    ]
    out = None
    for name, child, parent in checks:
        c = child.join(parent, "k", "left_anti") \
            .agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(name).alias("fk"), "n_orphans")
        out = c if out is None else out.unionByName(c)
    return out


def unique_violations(sa: DataFrame) -> DataFrame:
    """Keys breaking UNIQUE(post_id, content_id, analysis_method); a NULL content_id never collides."""
    return sa.where(F.col("content_id").isNotNull()).groupBy("post_id", "content_id", "analysis_method") \
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unique_external_ids(posts: DataFrame) -> DataFrame:
    """Keys breaking UNIQUE(source_id, external_id): (source, external_id) held by several posts."""
    return posts.groupBy("source", "external_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_violations(content: DataFrame) -> DataFrame:
    """Success needs a content_text key in the details, failure an error key."""
    def has(key):
        return F.variant_get("fetch_details", f"$.{key}", "variant").isNotNull()
    ok = F.when(F.col("fetch_success"), has("content_text")).otherwise(has("error"))
    return content.where(~F.coalesce(ok, F.lit(False))).select("id", "post_id", "fetch_success")
