"""Readers of landed comment documents at their limits: 30 threads a post, 2 replies a thread."""

import json

from pyspark.sql import functions as F

from chorus.sources import landed as L


def plain_alive(text):
    return text not in (None, "", "[deleted]", "[removed]")


def test_listing_threads_beyond_the_limits(spark, tmp_path):
    """The 30 kept threads are counted after the filters, the 2 replies before them."""
    def comment(i):
        body = "[deleted]" if i % 7 == 3 else f"comment {i}"
        replies = [("[removed]" if (i + j) % 4 == 0 else f"reply {i}.{j}") for j in range(i % 5)]
        kids = [{"kind": "more" if j == 1 and i % 6 == 0 else "t1", "data": {"body": r}} for j, r in enumerate(replies)]
        return {"kind": "more" if i % 11 == 5 else "t1",
                "data": {"body": body, "replies": {"data": {"children": kids}} if kids else None}}
    top = [comment(i) for i in range(50)]
    doc = {"post_id": "p", "listing": [{"kind": "Listing", "data": {"children": []}}, {"kind": "Listing", "data": {"children": top}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc) + "\n")
    want, k = [], 0
    for c in top:
        if c["kind"] != "t1" or not plain_alive(c["data"]["body"]) or k == 30:
            continue
        want.append((k, 0, c["data"]["body"]))
        kids = ((c["data"]["replies"] or {"data": {"children": []}})["data"]["children"])[:2]
        alive = [r["data"]["body"] for r in kids if r["kind"] == "t1" and plain_alive(r["data"]["body"])]
        want += [(k, 1 + j, r) for j, r in enumerate(alive)]
        k += 1
    got = L.listing_threads(L.read_json(spark, str(tmp_path), L.COMMENT_LISTING_SCHEMA))
    assert k == 30 and sorted((r.thread_ix, r.reply_ix, r.text) for r in got.collect()) == sorted(want)
    flat = L.flat_listing_comments(L.read_json(spark, str(tmp_path), L.COMMENT_LISTING_SCHEMA))
    assert sorted((r.ix, r.text) for r in flat.collect()) == sorted((a, t) for a, b, t in want if b == 0)


def test_item_threads_beyond_the_limits(spark, tmp_path):
    """The first 30 kids and the first 2 replies are taken before the filters."""
    items = [{"id": 1, "post_id": "hn_1", "kids": list(range(100, 150))}]
    for i in range(50):
        items.append({"id": 100 + i, "kids": [1000 + 10 * i + j for j in range(i % 5)], "text": f"comment {i}",
                      "deleted": i % 6 == 2, "dead": i % 9 == 4})
        items += [{"id": 1000 + 10 * i + j, "text": " " if (i + j) % 5 == 0 else f"reply {i}.{j}", "dead": j == 1 and i % 3 == 0}
                  for j in range(i % 5)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, items)) + "\n")
    by = {x["id"]: x for x in items}
    alive = lambda x: not x.get("deleted") and not x.get("dead") and x["text"].strip()
    want, k = [], 0
    for c in items[0]["kids"][:30]:
        if alive(by[c]):
            want.append((k, 0, by[c]["text"]))
            replies = [by[r]["text"] for r in by[c]["kids"][:2] if alive(by[r])]
            want += [(k, 1 + j, t) for j, t in enumerate(replies)]
            k += 1
    got = L.item_threads(L.read_json(spark, str(tmp_path), L.ITEM_SCHEMA))
    assert sorted((r.thread_ix, r.reply_ix, r.text) for r in got.collect()) == sorted(want) and k < 30


def test_landed_items_of_long_threads_keep_their_ids(spark, tmp_path):
    rows = [(7, 2 * i, j, f"{'comment' if j == 0 else 'reply'} {i}") for i in range(120) for j in (0, 1)]
    t = spark.createDataFrame(rows, "post_id long, thread_ix long, reply_ix int, text string")
    L.land_items(t, str(tmp_path / "items"))
    items = L.read_json(spark, str(tmp_path / "items"), L.ITEM_SCHEMA)
    assert items.count() == items.select("id").distinct().count() == 241
    got = L.item_threads(items, limit=1000).where(F.col("reply_ix") == 1).select("text").collect()
    assert sorted(r.text for r in got) == sorted(f"reply {i}" for i in range(120))


