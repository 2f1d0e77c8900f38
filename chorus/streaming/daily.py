"""Daily sentiment aggregate (A10) in batch and as a Structured Streaming job (R1),
and streaming de-duplication of posts (R2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chorus.functions.text import sentiment_label


def event_scores(events: DataFrame) -> DataFrame:
    """events -> (ts, day, topic_id, source, model_name, score): the daily-aggregate binding."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 20) / 50))
    return events.select("ts", F.to_date("ts").alias("d"), (F.col("user_id") % 3).alias("topic_id"),
                         F.col("event_type").alias("source"),
                         F.when(F.col("user_id") % 2 == 0, F.lit("rules")).otherwise(F.lit("lexicon")).alias("model_name"),
                         s.alias("s"))


def _aggs():
    lab = sentiment_label("s")
    return [F.count_if(lab == "positive").alias("positive_count"),
            F.count_if(lab == "negative").alias("negative_count"),
            F.count_if(lab == "neutral").alias("neutral_count"),
            # mean to 6 decimals, half up, in integers: a sum of doubles depends on the row order
            F.expr("((2 * sum(cast(round(abs(s) * 1000000) AS bigint)) + count(1)) div (2 * count(1))) / 1000000D")
            .alias("avg_confidence")]


def daily_sentiment_batch(events: DataFrame) -> DataFrame:
    """A10: per (date, topic, source, model): label counts and mean confidence."""
    return event_scores(events).groupBy(F.col("d").cast("string").alias("day"), "topic_id", "source", "model_name").agg(*_aggs())


def event_time(ts_ntz) -> F.Column:
    """timestamp_ntz -> timestamp at the same UTC wall-clock time, with no
    dependence on the session time zone (watermarks need a timestamp)."""
    secs = (F.datediff(F.to_date(ts_ntz), F.lit("1970-01-01").cast("date")).cast("long") * 86400
            + F.hour(ts_ntz) * 3600 + F.minute(ts_ntz) * 60 + F.second(ts_ntz))
    return F.timestamp_seconds(secs)


def _utc_day(ts) -> F.Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int")).cast("string")


def read_events(spark, source_dir: str, files_per_trigger: int = 1, glob: str = "events.parquet",
                delay: str = "1 day", source: str | None = None) -> DataFrame:
    """The events of a folder (of one ``source``, if given) as a file stream with their event time
    ``et`` under a watermark. The files of the events table lie in no order of time, so they are one
    micro-batch: taken ``files_per_trigger`` at a time, rows would be dropped as late."""
    if glob == "events.parquet":
        from chorus.sources.tables import stream_table
        ev = stream_table(spark, source_dir, "events")
    else:
        ev = (spark.readStream.schema(spark.read.parquet(source_dir).schema).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir))
    scored = event_scores(ev).withColumn("et", event_time(F.col("ts")))
    if source is not None:
        scored = scored.where(F.col("source") == source)
    return scored.withWatermark("et", delay)


def run_stream(stream: DataFrame, sink, checkpoint: str, output_mode: str) -> StreamingQuery:
    """All that is there now, through ``foreachBatch``; returns the ended query."""
    q = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def upsert(batch: DataFrame, epoch: int, out_dir: str, by: str) -> None:
    """Keyed upsert of one micro-batch: its rows replace the partition (``by`` value, epoch), and
    no other. A replayed epoch writes the same rows to the same place; :func:`latest`
    reads the newest row of every key."""
    (batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(by, "epoch").parquet(out_dir))


def latest(spark, out_dir: str, keys: list[str], schema: str) -> DataFrame:
    """The row of the last epoch per key of what :func:`upsert` wrote."""
    df = spark.read.schema(schema + ", epoch long").parquet(out_dir)
    rest = [c for c in df.columns if c not in keys and c != "epoch"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")


DAILY_KEYS = ["day", "topic_id", "source", "model_name"]
DAILY_SCHEMA = ("day string, topic_id long, source string, model_name string, positive_count long, negative_count long, "
                "neutral_count long, avg_confidence double")


def stream_daily_sentiment(spark, source_dir: str, out_dir: str, checkpoint: str,
                           files_per_trigger: int = 1, output_mode: str = "update",
                           glob: str = "events.parquet") -> DataFrame:
    """Events read as a file stream, 1-day tumbling windows per topic, source and model
    under a 1-day watermark; the result is returned read back.

    Update mode (the default): a micro-batch emits the days it has touched, which are
    upserted by key; a day's state is evicted once the watermark has passed its end, so
    the state holds the open days only. Append mode: a day is written once, when it is
    closed. In both, rows that arrive later than the watermark are dropped."""
    return start_daily_sentiment(spark, source_dir, out_dir, checkpoint, files_per_trigger, output_mode, glob)[0]


def start_daily_sentiment(spark, source_dir: str, out_dir: str, checkpoint: str, files_per_trigger: int = 1,
                          output_mode: str = "update", glob: str = "events.parquet") -> tuple[DataFrame, StreamingQuery]:
    """:func:`stream_daily_sentiment` with the ended query, whose progress holds the state's size."""
    agg = (read_events(spark, source_dir, files_per_trigger, glob)
           .groupBy(F.window("et", "1 day").alias("w"), "topic_id", "source", "model_name").agg(*_aggs()))

    def sink(batch: DataFrame, epoch: int) -> None:
        upsert(batch.select(_utc_day(F.col("w.start")).alias("day"), "topic_id", "source", "model_name", "positive_count",
                            "negative_count", "neutral_count", "avg_confidence"), epoch, out_dir, "day")
    q = run_stream(agg, sink, checkpoint, output_mode)
    return latest(spark, out_dir, DAILY_KEYS, DAILY_SCHEMA), q


def stream_dedup_posts(spark, source_dir: str, out_dir: str, checkpoint: str) -> DataFrame:
    """R2: posts streamed from the documents table (a file or a folder of files), de-duplicated on
    (source, external_id = md5 of the text) within a 60-day watermark on the
    post time; appended per micro-batch, returned read back."""
    from chorus.sources.tables import stream_table
    docs = stream_table(spark, source_dir, "documents")
    reddit = F.col("doc_id") % 2 == 0
    p = docs.select(
        F.when(reddit, F.lit("Reddit")).otherwise(F.lit("HackerNews")).alias("source"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("external_id"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") * 7919) % 2592000).alias("created"))
    d = p.withWatermark("created", "60 days").dropDuplicatesWithinWatermark(["source", "external_id"])

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.select("source", "external_id").write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    run_stream(d, sink, checkpoint, "append")
    return spark.read.parquet(out_dir).drop("epoch")
