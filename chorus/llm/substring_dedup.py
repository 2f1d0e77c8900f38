"""Substring de-duplication by Rabin-Karp hashes of fixed-length word windows.

Every window of ``width`` consecutive words gets the polynomial hash of its word
codes. A task keeps, of each window sequence it meets, the first place only (the
others are known to repeat it), so a passage shared by a third of all documents
reaches the shuffle once per task chunk. What is left is dealt by hash bucket as
packed arrays; a bucket finds the first place of every sequence and reports all
later ones. Reports meet their documents by hashed row number, overlapping and
adjacent windows merge into maximal spans, and the spans' words are removed.

Two hashes with different bases are computed per window: 64 bits travel, the
other one chooses the bucket. So windows are told apart by 64 + log2(buckets)
bits, and the bucket count grows with the corpus: about 1e-5 expected false
matches on 1e8 windows, a few on 1e13."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import (
    doc_ids, packed_parts, part_of, pieces, text_bytes, told_apart, unpack_part, word_bounds, word_codes)

BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
CHUNK_WINDOWS = 1_500_000  # windows a task holds before it packs them
BUCKET_BYTES = 16 << 20    # text bytes whose windows make one bucket
PART_BYTES = 8 << 20       # text bytes of the documents that are rewritten together


def window_hashes(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive codes, by doubling."""
    n = len(codes) - width + 1
    total, done, step, power, b = None, 0, codes, 1, base
    left = width
    while left:
        if left & 1:  # append ``power`` codes from position ``done``
            tail = step[done:done + n]
            total = tail.copy() if total is None else total * np.uint64(b) + tail
            done += power
        left >>= 1
        if left:
            step = step[:-power] * np.uint64(b) + step[power:]
            b, power = b * b & 0xFFFFFFFFFFFFFFFF, power * 2
    return total


def pack(ids: np.ndarray, places: np.ndarray, hashes: np.ndarray | None = None) -> bytes:
    """Places (sorted within runs of equal ids) and hashes as one byte string:
    run ids, run lengths, place gaps as byte planes, hashes."""
    new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    runs = np.diff(np.concatenate((new, [len(ids)])))
    gaps = np.diff(places, prepend=0)
    gaps[new] = places[new]
    planes = gaps.astype("<u4").view(np.uint8).reshape(-1, 4)
    n_planes = max(1, int(np.ceil(np.log2(int(gaps.max()) + 1) / 8))) if len(gaps) else 1
    body = [np.array([len(new), len(ids), n_planes, hashes is not None], "<u4").tobytes(),
            ids[new].astype("<i8").tobytes(), runs.astype("<u4").tobytes(),
            np.ascontiguousarray(planes[:, :n_planes].T).tobytes()]
    if hashes is not None:
        body.append(hashes.astype("<u8").tobytes())
    return b"".join(body)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    n_runs, n, n_planes, hashed = np.frombuffer(raw, "<u4", 4).tolist()
    at = 16
    ids = np.frombuffer(raw, "<i8", n_runs, at)
    runs = np.frombuffer(raw, "<u4", n_runs, at := at + 8 * n_runs).astype(np.int64)
    planes = np.zeros((n, 4), np.uint8)
    planes[:, :n_planes] = np.frombuffer(raw, np.uint8, n * n_planes, at := at + 4 * n_runs).reshape(n_planes, n).T
    gaps = planes.view("<u4")[:, 0].astype(np.int64)
    ends = np.cumsum(runs)
    total = np.cumsum(gaps)
    before = (total - gaps)[ends - runs] if n_runs else total
    places = total - np.repeat(before, runs)
    h = np.frombuffer(raw, "<u8", n, at + n * n_planes) if hashed else None
    return np.repeat(ids, runs), places, h


def _by_part(ids: np.ndarray, places: np.ndarray, n_parts: int):
    """(part, packed) of the document parts."""
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    part = part_of(ids, n_parts)
    order = np.argsort(part, kind="stable")
    ids, places, part = ids[order], places[order], part[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(part[a]), pack(ids[a:b], places[a:b])


def _scatter(width: int, n_buckets: int, n_parts: int):
    def flush(held):
        import pyarrow as pa
        h, g, ids, place = (np.concatenate(x) for x in zip(*held))
        if np.any(ids[1:] < ids[:-1]):
            order = np.argsort(ids, kind="stable")
            h, g, ids, place = h[order], g[order], ids[order], place[order]
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])))
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = order[(ids[order] != ids[first]) | (place[order] != place[first])]
        buckets, parts, raw = [], [], []
        for part, packed in _by_part(ids[later], place[later], n_parts) if len(later) else ():
            buckets.append(part % n_buckets)
            parts.append(part)
            raw.append(packed)
        keep = np.sort(order[new])
        keep = keep[np.argsort(g[keep], kind="stable")]
        g, h, ids, place = g[keep], h[keep], ids[keep], place[keep]
        edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            buckets.append(int(g[a]))
            parts.append(-1)
            raw.append(pack(ids[a:b], place[a:b], h[a:b]))
        for i in range(0, len(raw), 256):
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets[i:i + 256], pa.int64()), pa.array(parts[i:i + 256], pa.int64()),
                 pa.array(raw[i:i + 256], pa.binary())], ["bucket", "part", "data"])

    def run(batches):
        held, n = [], 0
        for batch, a, b, data, offs in pieces(batches):
            starts, ends, first = word_bounds(data, offs)
            if len(starts) < width:
                continue
            codes = word_codes(data, starts, ends)
            words = np.diff(first)
            doc = np.repeat(np.arange(b - a), words)
            place = np.arange(len(codes)) - first[doc]
            ok = np.flatnonzero(place + width <= words[doc])
            if not len(ok):
                continue
            h = window_hashes(codes, width, BASES[0])[ok]
            g = (window_hashes(codes, width, BASES[1])[ok] >> np.uint64(24)) % np.uint64(n_buckets)
            g = g.astype(np.uint16 if n_buckets <= 65536 else np.int64)
            held.append((h, g, doc_ids(batch, a, b, "uid")[doc[ok]], place[ok].astype(np.int32)))
            n += len(ok)
            if n >= CHUNK_WINDOWS:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)
    return run


def _judge(n_parts: int):
    """One hash bucket: the places of every window that is not the first of its hash."""
    def run(key, table):
        import pyarrow as pa
        parts, raw, held = [], [], []
        for part, data in zip(table.column("part").to_pylist(), table.column("data")):
            if part >= 0:
                parts.append(part)
                raw.append(data.as_py())
            else:
                held.append(unpack(data.as_py()))
        if held:
            ids, place, h = (np.concatenate(x) for x in zip(*held))
            del held
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            order = order[np.lexsort((place[order], ids[order], h[order]))]
            h, ids, place = h[order], ids[order], place[order]
            new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            later = (ids != ids[first]) | (place != place[first])
            for part, packed in _by_part(ids[later], place[later], n_parts) if later.any() else ():
                parts.append(part)
                raw.append(packed)
        return pa.table({"part": pa.array(parts, pa.int64()), "data": pa.array(raw, pa.binary())})
    return run


def _spans(places: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal removal spans [start, end) of sorted window places."""
    cut_at = np.flatnonzero(places[1:] > places[:-1] + width) + 1
    a = places[np.concatenate(([0], cut_at))]
    b = places[np.concatenate((cut_at - 1, [len(places) - 1]))] + width
    return list(zip(a.tolist(), b.tolist()))


def _rewrite(width: int):
    def run(key, docs, reports):
        import pyarrow as pa
        held = [unpack(x.as_py())[:2] for x in reports.column("data")]
        ids = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.int64)
        place = np.concatenate([x[1] for x in held]) if held else ids
        order = np.lexsort((place, ids))
        ids, place = ids[order], place[order]
        out_ids, n, gone, spans, kept = [], [], [], [], []
        for doc_id, i, text in (row for batch in unpack_part(docs) for row in zip(
                batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), batch.column("text"))):
            out_ids.append(doc_id)
            words = (text.as_py() or "").encode().split()
            a, b = np.searchsorted(ids, i, "left"), np.searchsorted(ids, i, "right")
            at = np.unique(place[a:b])
            at = at[at + width <= len(words)]
            own = _spans(at, width) if len(at) else []
            rest, last = [], 0
            for x, y in own:
                rest += words[last:x]
                last = y
            rest = rest + words[last:] if own else words
            n.append(len(words))
            gone.append(len(words) - len(rest))
            spans.append([{"start": x, "end": y} for x, y in own])
            kept.append(b" ".join(rest).decode())
        return pa.table([pa.array(out_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])
    return run


def substring_dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, spans array<struct<start,end>> of word places,
    kept_text) per document of (doc_id, text).

    A word goes if a window of ``width`` words over it starts earlier, by
    (doc_id, place), with the same words. Defined cases: a null or blank text has no
    words; texts shorter than the window keep all; a null doc_id sorts last; rows of
    one doc_id (or of none) with different texts are documents of their own, in the order
    of their texts' digests, and equal ones are one document with one result; a text
    of any length is read whole; an empty table gives no rows; other columns are not read."""
    docs = told_apart(docs)
    size = text_bytes(docs)
    n_buckets, n_parts = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // PART_BYTES))
    windows = docs.mapInArrow(_scatter(width, n_buckets, n_parts), "bucket long, part long, data binary")
    reports = windows.groupBy("bucket").applyInArrow(_judge(n_parts), "part long, data binary")
    return packed_parts(docs, n_parts).groupBy("part").cogroup(reports.groupBy("part")).applyInArrow(
        _rewrite(width), "doc_id long, n_words long, n_removed long, "
                         "spans array<struct<start:long,end:long>>, kept_text string")


def op1(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs, 20).select("doc_id", "n_words", "n_removed",
                                            F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
w AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d)),
l AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS rn FROM w) WHERE rn > 1),
g AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 20)))) AS gone FROM l GROUP BY doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept, count(*) AS n
      FROM p LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM g) x ON x.doc_id = p.doc_id AND x.i = p.i
      WHERE x.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
