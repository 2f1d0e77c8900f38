"""The streams beyond R1's append mode: upsert, late rows, restarts, state size, quarantine, each
against the same computation over a table."""

import os
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest

from chorus.sources import landed as L
from chorus.streaming import daily as D
from chorus.streaming import ingest as I
from chorus.streaming import shifts as S
from chorus.streaming import trends as T

T0 = datetime(2024, 1, 1)
COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def write(folder, name, rows):
    """One file of (hours since T0, user, source, value); later calls give later files."""
    os.makedirs(folder, exist_ok=True)
    df = pd.DataFrame([(i, T0 + timedelta(hours=h), u, s, float(v), "{}") for i, (h, u, s, v) in enumerate(rows)], columns=COLUMNS)
    df.to_parquet(os.path.join(folder, f"events-{name}.parquet"), coerce_timestamps="us")
    time.sleep(0.02)


def rows_of(df, digits=6):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect())


def events(spark, folder):
    return spark.read.parquet(folder)


# ------------------------------------------------------------------ R1 in update mode
def test_update_mode_replay_and_state_size(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for day in range(12):  # one file per day, and in each a row for the day before: days are touched twice
        rows = [(24 * day + h, u, "view", 70 if h % 3 else 0) for h in range(0, 24, 4) for u in range(6)]
        write(src, f"{day:02d}", rows + ([(24 * day - 1, 0, "view", 70)] if day else []))
    got, q = D.start_daily_sentiment(spark, src, out, ck, 1, "update", "events-*.parquet")
    want = rows_of(D.daily_sentiment_batch(events(spark, src)).select(*got.columns))
    assert rows_of(got) == want                          # nothing was later than the watermark
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    groups_a_day = 6  # topic x model
    assert len(sizes) >= 12 and max(sizes) <= 4 * groups_a_day  # open days only, not all twelve
    # a replayed epoch writes the same rows to the same place
    df = spark.read.parquet(out)
    last = df.agg({"epoch": "max"}).first()[0]
    for epoch in (0, last):
        batch = df.where(df.epoch == epoch).drop("epoch")
        D.upsert(spark.createDataFrame(batch.collect(), batch.schema), epoch, out, "day")
    again = D.latest(spark, out, D.DAILY_KEYS, D.DAILY_SCHEMA)
    assert rows_of(again) == want
    # a later run takes new files only, and a row behind the watermark is dropped
    write(src, "12", [(24 * 12, 0, "view", 70)])
    write(src, "13", [(5, 0, "view", 70)])
    got, _ = D.start_daily_sentiment(spark, src, out, ck, 1, "update", "events-*.parquet")
    days = {r.day: 0 for r in got.collect()}
    assert len(days) == 13 and [r for r in rows_of(got) if r[0] != "2024-01-13"] == want


# ------------------------------------------------------------------ trends
def test_period_trends_by_hand(spark, tmp_path):
    write(str(tmp_path), "a", [(0, 0, "view", 45), (24 * 7, 0, "view", 70), (24 * 8, 0, "view", 20), (24 * 21, 0, "view", 20),
                               (24 * 28, 0, "view", 20), (24 * 31, 0, "view", 70)])
    got = {r.period: (r.n, r["mean"], r.previous, r.change, r.direction) for r in T.period_trend(events(spark, str(tmp_path)), "week").collect()}
    assert got == {"2024-01-01": (1, 0.5, None, None, None), "2024-01-08": (2, 0.5, 0.5, 0.0, "flat"),
                   "2024-01-22": (1, 0.0, None, None, None),     # no events in the week before
                   "2024-01-29": (2, 0.5, 0.0, 0.5, "up")}
    month = {r.period: (r.n, r["mean"], r.direction) for r in T.period_trend(events(spark, str(tmp_path)), "month").collect()}
    assert month == {"2024-01-01": (5, 0.3, None), "2024-02-01": (1, 1.0, "up")}


def test_sliding_trend_stream_and_late_rows(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for k in range(6):
        write(src, f"{k}", [(24 * (4 * k + d) + h, u, "view", (13 * d + 7 * u + 3 * h) % 90) for d in range(4) for h in (1, 9) for u in (0, 1, 2)])
    on_time = T.sliding_trend(T.sliding_days(events(spark, src)))
    want = rows_of(on_time)
    write(src, "late", [(2, 0, "view", 0)])  # its windows are behind the watermark
    got = T.stream_sliding_trend(spark, src, out, ck, 1, "events-*.parquet")
    assert rows_of(got) == want and any(r[-1] == "up" for r in want) and any(r[-1] == "down" for r in want)
    assert rows_of(T.stream_sliding_trend(spark, src, out, ck, 1, "events-*.parquet")) == want  # a rerun adds nothing


# ------------------------------------------------------------------ shifts
def plain_shifts(rows, until=None):
    days = {}
    for h, u, s, v in rows:
        days.setdefault((u % 3, s), {}).setdefault(h // 24, []).append(round(max(-1.0, min(1.0, (v - 20) / 50)) * 1e6))
    out = []
    for (topic, source), per in days.items():
        n, base, up, low = 0, 0.0, 0.0, 0.0
        for day in sorted(per):
            if until is not None and day > until:
                continue
            x = sum(per[day]) / 1000000.0 / len(per[day])
            if n >= S.WARMUP:
                up, low = max(0.0, up + x - base - S.SLACK), max(0.0, low + base - x - S.SLACK)
                if up > S.LIMIT or low > S.LIMIT:
                    d = "up" if up > S.LIMIT else "down"
                    out.append((topic, source, str((T0 + timedelta(days=day)).date()), d, round(up if d == "up" else low, 6),
                                round(base, 6), round(x, 6)))
                    n, base, up, low = 1, x, 0.0, 0.0
                    continue
            n, base = n + 1, base + (x - base) / (n + 1)
    return sorted(out)


def shift_rows(days):
    level = [0.0, 0.5, 0.1, -0.4]
    return [(24 * d + 5 * k, u, s, 20 + 50 * (level[(d // 9 + u) % 4] + 0.02 * ((d * 7 + k) % 3)))
            for d in days for k in range(3) for u in (0, 1) for s in ("view", "click")]


def test_batch_shifts(spark, tmp_path):
    rows = shift_rows(range(40))
    write(str(tmp_path), "a", rows)
    got = rows_of(S.sentiment_shifts(events(spark, str(tmp_path))))
    assert got == plain_shifts(rows) and {r[3] for r in got} == {"up", "down"}


def test_shift_stream_with_restart(spark, tmp_path):
    """Two runs with one checkpoint give what one pass over all closed days gives; rows for a closed
    day are dropped, and a key that stays away for long starts anew."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows = shift_rows(range(40))
    for k in range(2):
        write(src, f"a{k}", [r for r in rows if r[0] // 24 // 10 == k])
    first = rows_of(S.stream_sentiment_shifts(spark, src, out, ck, 1, "events-*.parquet"))
    assert first == plain_shifts(rows, until=17)  # day 18 is open under the watermark of day 19
    for k in range(2, 4):
        write(src, f"b{k}", [r for r in rows if r[0] // 24 // 10 == k])
    write(src, "late", [(24 * 3, 0, "view", 70)] * 50)
    got = rows_of(S.stream_sentiment_shifts(spark, src, out, ck, 1, "events-*.parquet"))
    assert got == plain_shifts(rows, until=37) and len(got) > len(first) > 0


def test_shift_state_expires(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    low = [(24 * d, 0, "view", 20) for d in range(6)]
    write(src, "a", low)
    write(src, "b", [(24 * (6 + S.IDLE_DAYS + k), 1, "view", 20) for k in range(4)])           # moves the watermark on
    write(src, "c", [(24 * (12 + S.IDLE_DAYS + k), 0, "view", 70) for k in range(6)])          # back, on another level
    write(src, "d", [(24 * (30 + S.IDLE_DAYS), 1, "view", 20)])
    got = S.stream_sentiment_shifts(spark, src, out, ck, 1, "events-*.parquet")
    assert got.count() == 0  # with the old baseline the new level would be a shift
    assert len(plain_shifts(low + [(24 * (12 + S.IDLE_DAYS + k), 0, "view", 70) for k in range(6)])) == 1


# ------------------------------------------------------------------ two sources
def test_source_comparison_late_rows_on_either_side(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows = [(h, u, s, (11 * h + 5 * u + (17 if s == "click" else 0)) % 90)
            for h in range(0, 96, 1) for u in (0, 1) for s in ("view", "click") if (h + u) % 3 or s == "view"]
    for k in range(4):
        write(src, f"{k}", [r for r in rows if r[0] // 24 == k])
    write(src, "4", [(120, 0, "view", 20), (120, 0, "click", 20)])
    write(src, "5", [(121, 0, "view", 20), (121, 0, "click", 20)])
    closed = T.source_comparison(events(spark, src), "view", "click")
    limit = int((T0 - datetime(1970, 1, 1)).total_seconds()) + 3600 * (121 - 24)
    want = rows_of(closed.where((closed.hour_a + 3600 <= limit) & (closed.hour_b + 3600 <= limit)))
    write(src, "6", [(2, 0, "view", 70)] * 9)    # late on one side
    write(src, "7", [(3, 1, "click", 70)] * 9)   # and on the other
    got = T.stream_source_comparison(spark, src, out, ck, "view", "click", 2, 1, "events-*.parquet")
    assert rows_of(got) == want and len(want) > 300


# ------------------------------------------------------------------ S1 and S2
def test_listing_stream_quarantine_and_rerun(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    child = '{"kind":"t3","data":{"id":"%s","title":"%s","score":1}}'
    page = '{"kind":"Listing","data":{"children":[%s]}}'
    (docs / "a.txt").write_text("\n".join([
        page % ",".join([child % ("p1", "x"), child % ("p2", "y"), child % ("p3", ""), child % ("p1", "again")]),
        page[:30], '{"error": 404}', "", "not json", '{"kind":"Listing","data":{"children":"none"}}', page % ""]) + "\n")
    run = lambda: I.stream_listing_posts(spark, str(docs), str(tmp_path / "out"), str(tmp_path / "ck"))
    posts, broken = run()
    assert sorted(r.id for r in posts.collect()) == ["p1", "p2"]  # p3 has no title
    bad = [page[:30], '{"error": 404}', "", "not json", '{"kind":"Listing","data":{"children":"none"}}']
    assert sorted(r.raw for r in broken.collect()) == sorted(bad)
    posts, broken = run()                                          # nothing new
    assert posts.count() == 2 and broken.count() == 5
    (docs / "b.txt").write_text(page % ",".join([child % ("p2", "seen"), child % ("p4", "new")]) + "\n" + "not json\n")
    posts, broken = run()
    assert sorted((r.id, r.title) for r in posts.collect() if r.id != "p1") == [("p2", "y"), ("p4", "new")]
    assert broken.count() == 5
    assert posts.columns == L.ingest_listing_posts(spark.createDataFrame([], L.LISTING_SCHEMA)).columns


def test_hits_stream(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text('{"hits":[{"objectID":"1","title":"a"},{"objectID":"2","title":"b","url":null}]}\n{"hits":[{"obj\n')
    run = lambda: I.stream_hits_posts(spark, str(docs), str(tmp_path / "out"), str(tmp_path / "ck"))
    posts, broken = run()
    want = [("hn_1", "https://news.ycombinator.com/item?id=1"), ("hn_2", None)]
    assert sorted((r.id, r.url) for r in posts.collect()) == want and broken.count() == 1
    (docs / "b.txt").write_text('{"hits":[{"objectID":"2","title":"b"},{"objectID":"3","title":"c","url":"u"}]}\n')
    posts, broken = run()
    assert sorted((r.id, r.url) for r in posts.collect()) == [*want, ("hn_3", "u")] and broken.count() == 1
