"""Helpers shared by the operators: table access, lineage cuts, distributed
prefix sums and byte-level views of Arrow text columns."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorus.session import ensure_checkpoint_dir

# White space of the word definition [^\x20\x09-\x0D]+
WS = "\\x20\\x09-\\x0D"
# Bytes of text worked on at once inside a task (a longer document is one piece).
PIECE_BYTES = 4 << 20
NULL_ID = (1 << 63) - 1  # stands for a null doc_id inside tasks: sorts last


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by spark.checkpoint.dir."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text (null: 0); each word with the
    white space around it becomes one character, so memory stays near the text's."""
    one = F.regexp_replace(text, f"[{WS}]*[^{WS}]+[{WS}]*", "x")
    return F.when(text.rlike(f"[^{WS}]"), F.length(one)).otherwise(0).cast("long")


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Total UTF-8 bytes of a text column: one aggregate, one number to the driver."""
    return docs.agg(F.sum(F.octet_length(col).cast("long"))).first()[0] or 0


def hash_key(seed: int, *cols: Column) -> Column:
    """60-bit non-negative pseudo-random key of a row (leading md5 digits)."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit("|"), F.coalesce(c.cast("string"), F.lit("\x00"))]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("long")


def key_bucket(key: Column, n: int) -> Column:
    """Range bucket 0..n-1 of a 60-bit key; monotone in the key."""
    return F.shiftright(F.shiftright(key, 30) * F.lit(n), 30)


def bucket_sums(df: DataFrame, group: list[str], bucket: str, value: Column) -> DataFrame:
    """One row per (group, bucket) with ``_sum`` and ``_rows``; written once, small."""
    return cut(df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows")))


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column],
                value: Column, out: str, per: DataFrame | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, rows ordered by
    (``bucket``, ``order``). Two steps, so that no group is ordered in one task:
    sums per (group, bucket) give each bucket its offset, a window inside the
    bucket gives the rest. ``group`` columns must not be null. ``per`` may hold
    :func:`bucket_sums` of the same rows."""
    keys = [*group, bucket]
    per = bucket_sums(df, group, bucket, value) if per is None else per
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_loc", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (local.join(offs, keys).withColumn(out, F.col("_loc") + F.col("_off"))
            .drop("_loc", "_off"))


def source_key(col: Column) -> Column:
    """Non-null group key of a nullable source."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col))


# ---------------------------------------------------------------- inside tasks

_NONWS = np.ones(256, bool)
_NONWS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def arrow_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null reads as empty."""
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data, offs


def pieces(batches, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple]:
    """(batch, first row, end row, bytes, offsets) in pieces of whole documents of
    at most ``limit`` bytes, or one longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = arrow_bytes(batch.column(text))
        a = 0
        while a < len(offs) - 1:
            b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
            b = min(max(b, a + 1), len(offs) - 1)
            yield batch, a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
            a = b


def word_bounds(data: np.ndarray, offs: np.ndarray, chars: np.ndarray = _NONWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (runs of bytes in ``chars``), and each document's
    first word index."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    nonws = chars[data]
    first = nonws.copy()
    first[1:] &= ~nonws[:-1]
    at = offs[:-1][offs[:-1] < offs[1:]]
    first[at] = nonws[at]
    last = nonws.copy()
    last[:-1] &= ~nonws[1:]
    at = offs[1:][offs[:-1] < offs[1:]] - 1
    last[at] = nonws[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_BLOCK = 1 << 20


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inv = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = []
        for b in (_BASE, inv):
            p = np.full(max(n, 2 * _BLOCK), b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit code of every word: the polynomial of its bytes, mixed."""
    codes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + _BLOCK, "right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[:b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        codes[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(codes)


def doc_ids(batch, a: int, b: int, col: str = "doc_id") -> np.ndarray:
    """int64 ids of rows a..b; null becomes NULL_ID."""
    import pyarrow.compute as pc
    return pc.fill_null(batch.column(col).slice(a, b - a), NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def worker_cache(key, make):
    """``make()`` once per Python worker process and key (workers serve many tasks)."""
    import sys
    import types
    store = sys.modules.setdefault("_chorus_llm_cache", types.ModuleType("_chorus_llm_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def drop_worker_cache() -> None:
    """Forget what :func:`worker_cache` holds: a worker that goes on with another stage
    need not keep an earlier stage's tables."""
    import sys
    store = sys.modules.get("_chorus_llm_cache")
    if store is not None:
        store.__dict__.clear()


def part_of(ids: np.ndarray, n_parts: int) -> np.ndarray:
    """Document part of each id: the rule that lets documents meet reports on them."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)


def told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text, uid): a number that is one row's own, or shared by rows that are equal in id
    and text (a null text as an empty one). It orders rows by (doc_id, null last, digest of
    the text). Where no id repeats it is the id itself; else it is a place in a range
    partitioning by (doc_id, digest), which is written once."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    most, largest, nulls = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(
        F.max("n"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if (most or 0) <= 1 and not (nulls and largest == NULL_ID):
        return docs.withColumn("uid", F.coalesce("doc_id", F.lit(NULL_ID)))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    placed = cut(docs.withColumn("h", digest).repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("uid", F.monotonically_increasing_id()))

    def first(batches):
        import pyarrow as pa
        last = uid = None
        for batch in batches:
            out = []
            for key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "uid"))):
                if key[:2] != last:
                    last, uid = key[:2], key[2]
                out.append(uid)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(out, pa.int64())],
                                             ["doc_id", "text", "uid"])
    return placed.mapInArrow(first, "doc_id long, text string, uid long")


def packed_parts(docs: DataFrame, n_parts: int, level: int = 3) -> DataFrame:
    """(part, data): (doc_id, text, uid) rows dealt by hashed uid, those of one part in an Arrow
    batch packed together with zstd, so that the text's shuffle is near its size on disk."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.ipc as ipc
        for batch in batches:
            if not batch.num_rows:
                continue
            part = part_of(doc_ids(batch, 0, batch.num_rows, "uid"), n_parts)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) > 0, [True]))).tolist()
            keys, raw = [], []
            for a, b in zip(edges, edges[1:]):
                sink = pa.BufferOutputStream()
                with ipc.new_stream(sink, batch.schema, options=ipc.IpcWriteOptions(
                        compression=pa.Codec("zstd", level))) as out:
                    out.write_batch(batch.take(pa.array(order[a:b])))
                keys.append(int(part[order[a]]))
                raw.append(sink.getvalue().to_pybytes())
                if len(raw) == 64 or b == edges[-1]:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(raw, pa.binary())],
                                                     ["part", "data"])
                    keys, raw = [], []
    return docs.mapInArrow(run, "part long, data binary")


def unpack_part(table):
    """Record batches (doc_id, text, uid) of one part."""
    import pyarrow.ipc as ipc
    return [b for x in table.column("data") for b in ipc.open_stream(x.as_buffer())]
