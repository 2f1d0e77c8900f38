"""Sentiment over time: weekly and monthly trends, sliding windows, and the comparison of two
sources, each as one plan that runs on a table and on a stream.

Sums are kept in millionths as integers, so that a mean does not depend on the order of
its rows; a mean is the quotient to 6 decimals, half up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.streaming.daily import event_scores, event_time, latest, read_events, run_stream, upsert

WINDOW_DAYS = 7
MICROS = "cast(round(s * 1000000) AS bigint)"
FLAT = 0.01  # a smaller change of the mean counts as none


def mean6(total: str, n: str) -> Column:
    """total / n in millionths, half up, as a double of 6 decimals."""
    return F.expr(f"(sign({total}) * ((2 * abs({total}) + {n}) div (2 * {n}))) / 1000000D")


def timed(events: DataFrame) -> DataFrame:
    """The scored events of a table with the event time ``et``."""
    return event_scores(events).withColumn("et", event_time(F.col("ts")))


def direction(change: Column) -> Column:
    return (F.when(change.isNull(), F.lit(None).cast("string")).when(change >= FLAT, "up").when(change <= -FLAT, "down")
            .otherwise("flat"))


def with_previous(periods: DataFrame, keys: list[str], start: str, lag: int, before: Column) -> DataFrame:
    """``previous`` mean: that of the row ``lag`` periods back, if its start is ``before`` (a period
    without events has no row, and then there is no comparison); ``change`` and ``direction``.
    A window holds the periods of one key, whose number is bounded by time, not by events."""
    w = Window.partitionBy(*keys).orderBy(start)
    prev = F.when(F.lag(start, lag).over(w) == before, F.lag("mean", lag).over(w))
    out = periods.withColumn("previous", prev)
    return out.withColumn("change", F.round(F.col("mean") - F.col("previous"), 6)).withColumn("direction", direction(F.col("change")))


def period_trend(events: DataFrame, unit: str) -> DataFrame:
    """Per topic, source and calendar period (``week``, starting on Monday, or ``month``): number of
    events, mean score, the mean of the period before, the change and its direction."""
    sums = event_scores(events).groupBy(
        "topic_id", "source", F.trunc("d", unit).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"sum({MICROS})").alias("total"))
    means = sums.select("topic_id", "source", F.col("p"), "n", mean6("total", "n").alias("mean"))
    step = F.date_sub("p", 7) if unit == "week" else F.add_months("p", -1)
    out = with_previous(means, ["topic_id", "source"], "p", 1, step)
    return out.select("topic_id", "source", F.col("p").cast("string").alias("period"), "n", "mean", "previous", "change",
                      "direction")


def sliding_sums(timed_events: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """(topic_id, source, w, n, total) of event-time windows of ``days`` days that slide by one."""
    return timed_events.groupBy(F.window("et", f"{days} days", "1 day").alias("w"), "topic_id", "source").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"sum({MICROS})").alias("total"))


def sliding_days(events: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """The same sums of a table, with the window's start day: events are combined per day first, so
    that a day's sum, not every event, is copied to the windows it belongs to."""
    per = event_scores(events).groupBy("topic_id", "source", "d").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"sum({MICROS})").alias("total"))
    back = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    return (per.withColumn("k", back).withColumn("start", F.date_sub("d", F.col("k")))
            .groupBy("topic_id", "source", "start").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))


def sliding_trend(sums: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Each window's mean against that of the last window without an event in common
    (``days`` windows back). ``sums``: (topic_id, source, start day, n, total)."""
    means = sums.select("topic_id", "source", F.col("start").cast("date").alias("p"), "n", mean6("total", "n").alias("mean"))
    out = with_previous(means, ["topic_id", "source"], "p", days, F.date_sub("p", days))
    return out.select("topic_id", "source", F.col("p").cast("string").alias("start"), "n", "mean", "previous", "change",
                      "direction")


def utc_date(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def window_rows(sums: DataFrame) -> DataFrame:
    return sums.select(utc_date(F.col("w.start")).cast("string").alias("start"), "topic_id", "source", "n", "total")


def stream_sliding_trend(spark, source_dir: str, out_dir: str, checkpoint: str, files_per_trigger: int = 1,
                         glob: str = "events.parquet", days: int = WINDOW_DAYS) -> DataFrame:
    """:func:`sliding_trend` kept up to date by a stream: the windows that a micro-batch touches are
    upserted, closed windows leave the state, later rows for them are dropped; the
    comparison is made over the table that is read back."""
    def sink(batch: DataFrame, epoch: int) -> None:
        upsert(window_rows(batch), epoch, out_dir, "start")
    run_stream(sliding_sums(read_events(spark, source_dir, files_per_trigger, glob), days), sink, checkpoint, "update")
    return sliding_trend(latest(spark, out_dir, ["start", "topic_id", "source"],
                                "start string, topic_id long, source string, n long, total long"), days)


# ------------------------------------------------------------------ two sources

COMPARE_SCHEMA = "topic_id long, hour_a long, hour_b long, n_a long, n_b long, mean_a double, mean_b double, gap double"


def hourly(timed_events: DataFrame, tag: str) -> DataFrame:
    """Hourly number and mean of a source's events per topic, columns suffixed with ``tag``; the
    hour in seconds since 1970."""
    sums = timed_events.groupBy(F.window("et", "1 hour").alias("w"), "topic_id").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"sum({MICROS})").alias("total"))
    return sums.select(F.col("topic_id").alias(f"topic_{tag}"), F.window_time("w").alias(f"at_{tag}"),
                       F.unix_seconds("w.start").alias(f"hour_{tag}"), F.col("n").alias(f"n_{tag}"), mean6("total", "n").alias(f"mean_{tag}"))


def compare_sources(a: DataFrame, b: DataFrame, hours: int = 2) -> DataFrame:
    """Every hour of source a with the hours of source b on the same topic that start with it or
    at most ``hours`` hours later: numbers, means and the gap b - a. On streams this is a
    stream-stream join whose state both watermarks and the time range bound."""
    near = ((F.col("topic_a") == F.col("topic_b")) & (F.col("at_b") >= F.col("at_a"))
            & (F.col("at_b") <= F.col("at_a") + F.expr(f"interval {hours} hours")))
    return a.join(b, near).select(
        F.col("topic_a").alias("topic_id"), "hour_a", "hour_b", "n_a", "n_b", "mean_a", "mean_b",
        F.round(F.col("mean_b") - F.col("mean_a"), 6).alias("gap"))


def source_comparison(events: DataFrame, source_a: str, source_b: str, hours: int = 2) -> DataFrame:
    """:func:`compare_sources` over a table."""
    t = timed(events)
    return compare_sources(hourly(t.where(F.col("source") == source_a), "a"),
                           hourly(t.where(F.col("source") == source_b), "b"), hours)


def stream_source_comparison(spark, source_dir: str, out_dir: str, checkpoint: str, source_a: str, source_b: str,
                             hours: int = 2, files_per_trigger: int = 1, glob: str = "events.parquet",
                             delay: str = "1 day") -> DataFrame:
    """:func:`compare_sources` over two streams: an hour counts once the watermark (``delay`` behind
    the slower source) has passed its end; rows that arrive later, on either side, are
    dropped. One folder per epoch, which a replayed epoch overwrites; returned read back."""
    def side(source, tag):
        return hourly(read_events(spark, source_dir, files_per_trigger, glob, delay, source), tag)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
    run_stream(compare_sources(side(source_a, "a"), side(source_b, "b"), hours), sink, checkpoint, "append")
    return spark.read.schema(COMPARE_SCHEMA + ", epoch long").parquet(out_dir).drop("epoch")
