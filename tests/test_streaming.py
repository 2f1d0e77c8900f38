"""Streaming: late data under the watermark (append mode) on a small fixture."""

import os
import tempfile
import time
from datetime import datetime

import pandas as pd

from chorus.streaming import daily as D


def _events(rows):
    return pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])


def test_append_mode_drops_late_rows(spark):
    base = tempfile.mkdtemp(prefix="chorus-stream-", dir="/tmp")
    src = os.path.join(base, "src")
    os.makedirs(src)
    first = _events([
        (1, datetime(2024, 1, 1, 10), 0, "view", 70.0, "{}"),   # day 1, positive
        (2, datetime(2024, 1, 1, 11), 0, "view", 0.0, "{}"),    # day 1, negative
        (3, datetime(2024, 1, 3, 12), 0, "view", 70.0, "{}"),   # day 3 moves the watermark to day 2
    ])
    filler = _events([(4, datetime(2024, 1, 3, 13), 0, "view", 20.0, "{}")])  # day 3, neutral
    late = _events([(5, datetime(2024, 1, 1, 12), 0, "view", 70.0, "{}")])    # day 1 again, too late
    # Spark filters late rows with the previous batch's watermark and evicts
    # state with the current one: batch 1 (filler) closes day 1 under the
    # watermark set by batch 0; the day-1 row of batch 2 is then dropped.
    for i, df in enumerate([first, filler, late]):
        df.to_parquet(os.path.join(src, f"events{i + 1}.parquet"), coerce_timestamps="us")
        time.sleep(1.1)
    out = D.stream_daily_sentiment(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"),
                                   files_per_trigger=1, output_mode="append", glob="events*.parquet")
    rows = {r.day: r for r in out.collect()}
    assert set(rows) == {"2024-01-01"}            # day 3 is still open
    d1 = rows["2024-01-01"]
    assert (d1.positive_count, d1.negative_count, d1.neutral_count) == (1, 1, 0)   # late row dropped


def test_update_mode_equals_batch(spark):
    from chorus.sources.tables import read
    from tests.conftest import SF_SMALL
    base = tempfile.mkdtemp(prefix="chorus-stream-", dir="/tmp")
    s = D.stream_daily_sentiment(spark, SF_SMALL, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    b = D.daily_sentiment_batch(read(spark, SF_SMALL, "events"))
    cols = ["day", "topic_id", "source", "model_name", "positive_count", "negative_count", "neutral_count", "avg_confidence"]
    assert sorted(map(tuple, s.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_tables_of_several_files(spark):
    """A table may be a folder of files, in no order of time: every row is streamed."""
    from pyspark.sql import functions as F

    base = tempfile.mkdtemp(prefix="chorus-stream-", dir="/tmp")
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 25).alias("text"))
    docs.repartition(4).write.parquet(os.path.join(base, "documents.parquet"))
    got = D.stream_dedup_posts(spark, base, os.path.join(base, "out"), os.path.join(base, "ckpt")).collect()
    want = {(i % 2, i % 25) for i in range(60)}
    assert len(got) == len(set(got)) == len(want)

    os.makedirs(os.path.join(base, "events.parquet"))
    for i in range(3):  # the latest day first
        rows = _events([(i, datetime(2024, 1, 20 - 6 * i, 10), 0, "view", 70.0, "{}")])
        rows.to_parquet(os.path.join(base, "events.parquet", f"part-{i}.parquet"), coerce_timestamps="us")
        time.sleep(1.1)
    days = D.stream_daily_sentiment(spark, base, os.path.join(base, "out-days"), os.path.join(base, "ckpt-days")).collect()
    assert sorted((r.day, r.positive_count) for r in days) == [("2024-01-08", 1), ("2024-01-14", 1), ("2024-01-20", 1)]
