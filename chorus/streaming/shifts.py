"""Shift detection: a two-sided cumulative-sum test on the daily mean score of every
(topic, source), as a batch fold and as a stream with keyed state.

The baseline is the mean of the daily means since the last shift. After ``WARMUP`` days each
day adds how far its mean lies above (below) the baseline, less ``SLACK``, to the upper
(lower) sum, which never falls below 0. A sum above ``LIMIT`` is a shift: it is
reported with the day, and the test starts again with that day as its baseline."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from chorus.streaming.daily import event_scores, read_events, run_stream
from chorus.streaming.trends import MICROS

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

WARMUP, SLACK, LIMIT = 3, 0.05, 0.4
IDLE_DAYS = 60  # a key without events for as long forgets its test
DAY_MS = 86_400_000
SHIFT_SCHEMA = "topic_id long, source string, day string, direction string, statistic double, baseline double, mean double"


def step(state: tuple, x: float) -> tuple[tuple, tuple | None]:
    """One day of the test: (days, baseline, upper, lower) -> the same after it, and the shift
    (direction, statistic, baseline) if there is one. The stream's form of :func:`_fold`."""
    days, base, upper, lower = state
    if days >= WARMUP:
        upper = max(0.0, upper + (x - base - SLACK))
        lower = max(0.0, lower + (base - x - SLACK))
        if upper > LIMIT or lower > LIMIT:
            return (1, x, 0.0, 0.0), (("up", upper, base) if upper > LIMIT else ("down", lower, base))
    return (days + 1, base + (x - base) / (days + 1), upper, lower), None


# ------------------------------------------------------------------ batch

def _fold(days: Column) -> Column:
    """The test over an array of (day, mean) in order, as one expression."""
    start = F.struct(F.lit(0).alias("days"), F.lit(0.0).alias("base"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"),
                     F.expr("cast(array() as array<struct<day:date,direction:string,statistic:double,baseline:double,"
                            "mean:double>>)").alias("found"))

    def one(acc, d):
        x = d["mean"]
        ready = acc["days"] >= WARMUP
        upper = F.when(ready, F.greatest(F.lit(0.0), acc["upper"] + (x - acc["base"] - SLACK))).otherwise(acc["upper"])
        lower = F.when(ready, F.greatest(F.lit(0.0), acc["lower"] + (acc["base"] - x - SLACK))).otherwise(acc["lower"])
        hit = ready & ((upper > LIMIT) | (lower > LIMIT))
        shift = F.struct(d["day"].alias("day"), F.when(upper > LIMIT, "up").otherwise("down").alias("direction"),
                         F.when(upper > LIMIT, upper).otherwise(lower).alias("statistic"), acc["base"].alias("baseline"),
                         x.alias("mean"))
        zero = F.lit(0.0)
        return F.struct(F.when(hit, F.lit(1)).otherwise(acc["days"] + 1).alias("days"),
                        F.when(hit, x).otherwise(acc["base"] + (x - acc["base"]) / (acc["days"] + 1)).alias("base"),
                        F.when(hit, zero).otherwise(upper).alias("upper"), F.when(hit, zero).otherwise(lower).alias("lower"),
                        F.when(hit, F.concat(acc["found"], F.array(shift))).otherwise(acc["found"]).alias("found"))
    return F.aggregate(days, start, one, lambda acc: acc["found"])


def daily_means(events: DataFrame) -> DataFrame:
    """(topic_id, source, day, mean) from sums in millionths."""
    sums = event_scores(events).groupBy("topic_id", "source", F.col("d").alias("day")).agg(
        F.expr(f"sum({MICROS})").alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.select("topic_id", "source", "day", (F.col("total") / 1000000.0 / F.col("n")).alias("mean"))


def sentiment_shifts(events: DataFrame, until: Column | None = None) -> DataFrame:
    """All shifts of a table of events, up to the day ``until`` if given. Events are combined per day
    before a key's days (as many as the calendar has) meet in one row."""
    days = daily_means(events)
    if until is not None:
        days = days.where(F.col("day") <= until)
    series = days.groupBy("topic_id", "source").agg(F.array_sort(F.collect_list(F.struct("day", "mean"))).alias("days"))
    found = series.select("topic_id", "source", F.inline(_fold(F.col("days"))))
    return found.select("topic_id", "source", F.col("day").cast("string").alias("day"), "direction",
                        F.round("statistic", 6).alias("statistic"), F.round("baseline", 6).alias("baseline"),
                        F.round("mean", 6).alias("mean"))


# ------------------------------------------------------------------ stream

class ShiftDetector(StatefulProcessor):
    """Keyed state of one (topic, source): sums of the open days, and the test over the closed
    ones. A timer at a day's end (event time) closes it; one ``IDLE_DAYS`` after the last
    closed day drops the test of a key that has gone quiet."""

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day long", "total long, n long")
        self.test = handle.getValueState("test", "days int, base double, upper double, lower double, last long")

    def handleInputRows(self, key, rows, timerValues):
        sums: dict[int, list[int]] = {}
        for df in rows:
            for day, total, n in zip(df["day"], df["total"], df["n"]):
                s = sums.setdefault(int(day), [0, 0])
                s[0] += int(total)
                s[1] += int(n)
        for day, (total, n) in sums.items():
            if self.open.containsKey((day,)):
                old = self.open.getValue((day,))
                total, n = total + old[0], n + old[1]
            else:
                self.handle.registerTimer((day + 1) * DAY_MS)
            self.open.updateValue((day,), (total, n))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd
        now = timerValues.getCurrentWatermarkInMs()
        closed = sorted(d[0] for d in self.open.keys() if (d[0] + 1) * DAY_MS <= now)
        kept = self.test.get() if self.test.exists() else None
        state, last = ((kept[0], kept[1], kept[2], kept[3]), kept[4]) if kept else ((0, 0.0, 0.0, 0.0), -1)
        if not closed:
            if kept and (last + 1 + IDLE_DAYS) * DAY_MS <= now:
                self.test.clear()
            return
        out = []
        for day in closed:
            total, n = self.open.getValue((day,))
            self.open.removeKey((day,))
            if last >= 0 and day - last > IDLE_DAYS:
                state = (0, 0.0, 0.0, 0.0)
            mean = total / 1000000.0 / n
            state, shift = step(state, mean)
            last = day
            if shift:
                out.append((key[0], key[1], str((pd.Timestamp("1970-01-01") + pd.Timedelta(days=day)).date()), shift[0],
                            round(shift[1], 6), round(shift[2], 6), round(mean, 6)))
        self.test.update((*state, last))
        self.handle.registerTimer((last + 1 + IDLE_DAYS) * DAY_MS)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SHIFT_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_sentiment_shifts(spark, source_dir: str, out_dir: str, checkpoint: str, files_per_trigger: int = 1,
                            glob: str = "events.parquet") -> DataFrame:
    """:func:`sentiment_shifts` over a stream: a day counts once the 1-day watermark has passed its
    end, rows that arrive later for it are dropped by the engine. The state of open
    days and tests is in the state store, so a restarted stream goes on where it was.
    One folder per epoch; returned read back."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, STATE_STORE)  # keyed state with timers needs this store
    try:
        ev = read_events(spark, source_dir, files_per_trigger, glob)
        rows = ev.select("topic_id", "source", "et", F.floor(F.unix_seconds("et") / 86400).cast("long").alias("day"),
                         F.expr(MICROS).alias("total"), F.lit(1).cast("long").alias("n"))
        found = rows.groupBy("topic_id", "source").transformWithStateInPandas(
            ShiftDetector(), outputStructType=SHIFT_SCHEMA, outputMode="append", timeMode="eventTime")

        def sink(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
        run_stream(found, sink, checkpoint, "append")
    finally:
        spark.conf.set(conf, before) if before else spark.conf.unset(conf)
    return spark.read.schema(SHIFT_SCHEMA + ", epoch long").parquet(out_dir).drop("epoch")
