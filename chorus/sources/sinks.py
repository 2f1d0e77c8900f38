"""Sinks: JSON lines, CSV and the parquet store, each with its read-back.

Output goes under ``spark.chorus.output.dir`` or, when unset, a folder in the
shared checkpoint directory (never a machine-local path on a cluster). Every
write gets its own sub-folder, so re-runs never clobber each other."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.functions.text import text_preview

CSV_COLUMNS = ["post_id", "title", "subreddit", "source", "claude_version", "score", "compound",
               "sentiment_label", "positive", "neutral", "negative", "text_preview"]
CSV_SCHEMA = ("post_id string, title string, subreddit string, source string, claude_version string, score bigint, "
              "compound double, sentiment_label string, positive double, neutral double, negative double, "
              "text_preview string")


def output_root(spark: SparkSession) -> str:
    from chorus.session import ensure_checkpoint_dir
    return spark.conf.get("spark.chorus.output.dir", None) or os.path.join(ensure_checkpoint_dir(spark), "out")


def output_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(output_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def write_posts_json(df: DataFrame, path: str) -> DataFrame:
    """Full records as JSON lines (non-ASCII kept), read back with the same schema."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def sentiment_csv_frame(scored: DataFrame) -> DataFrame:
    """The 12 fixed CSV columns."""
    return scored.select(
        F.col("id").alias("post_id"), "title", "subreddit", "source", "claude_version", "score",
        F.col("title_compound").alias("compound"), "sentiment_label", F.col("title_positive").alias("positive"),
        F.col("title_neutral").alias("neutral"), F.col("title_negative").alias("negative"),
        text_preview("title", "selftext").alias("text_preview"))


def write_sentiment_csv(frame: DataFrame, path: str) -> DataFrame:
    (frame.select(*CSV_COLUMNS).write.mode("overwrite").option("header", True)
     .option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return (frame.sparkSession.read.schema(CSV_SCHEMA).option("header", True).option("multiLine", True)
            .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(path))
