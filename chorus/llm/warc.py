"""WARC archives: Spark writes the records and reads them back by byte offsets.

Writing is one projection into Spark's text writer. Reading splits files at the
record magic, wherever it stands, so any task may read any part of a file. Each
task emits, for every magic it meets, the candidate's start and the start of
its successor (end of header + Content-Length + 4). Inside a split a candidate's
chain is followed to where it leaves the split; across splits, pointer jumping
from each file's start doubles the jumps until no new split is entered. Only
candidates on a chain from a file's start are records: a magic inside a
payload is never the successor of one."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorus.llm.common import cut
from chorus.session import ensure_checkpoint_dir

MAGIC = "WARC/1.0\r\n"
BROADCAST_DIGESTS = 20_000  # repeated payload digests sent to all tasks at most; above, a shuffle join
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Base32 SHA-1 of a binary column: 5 hexadecimal digits are 4 base32 characters."""
    hexed = F.sha1(payload)
    out = []
    for g in range(8):
        v = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_B32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _urn(page_id: Column, url: Column) -> Column:
    m = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(url, F.lit(""))))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(m, a, n) for a, n in cuts]), F.lit(">"))


def archive_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to): of the
    records with equal payloads of at least ``min_bytes`` bytes, the one with the
    largest page_id is the response, the others revisit it.

    Null html is an empty payload. A null page_id never is the response of a group
    that holds another id; rows that repeat the largest page_id are all responses.
    Payloads are matched by SHA-1 digest; only (page_id, digest) is grouped, with
    partial aggregation, and the html itself moves only if more digests repeat
    than ``BROADCAST_DIGESTS``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.octet_length(payload).cast("long").alias("payload_bytes"),
                        sha1_base32(payload).alias("payload_digest"))
    groups = cut(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                 .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
                 .where("_n > 1 and _first is not null").drop("_n"))
    if groups.count() <= BROADCAST_DIGESTS:
        groups = F.broadcast(groups)
    rows = rows.join(groups, "payload_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.select("page_id", "url", "html", "payload_bytes", "payload_digest",
                       F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
                       F.when(again, F.col("_first")).alias("refers_to"))


def write_archive(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """One WARC file per partition, uncompressed, so that readers can split it."""
    crlf = "\r\n"
    rev = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK" + crlf + "Content-Type: text/html; charset=utf-8" + crlf + "Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(crlf + crlf))
    length = F.octet_length(http) + F.when(rev, F.lit(0)).otherwise(F.col("payload_bytes"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value.cast("string"), F.lit(crlf))
    head = F.concat(
        F.lit(MAGIC), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", _urn(F.col("page_id"), F.col("url"))),
        field("WARC-Date", F.lit(date)), field("WARC-Target-URI", url),
        F.coalesce(field("X-Page-ID", F.col("page_id")), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("X-Payload-Length", F.col("payload_bytes")),
        F.when(rev, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("X-Refers-To-Page-ID", F.col("refers_to"))))
        .otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http;msgtype=response")), field("Content-Length", length), F.lit(crlf))
    body = F.when(rev, F.lit("")).otherwise(F.coalesce("html", F.lit("")))
    # the writer's line separator is the second half of the CRLF CRLF that ends a record
    records.select(F.concat(head, http, body, F.lit(crlf)).alias("value")).write.option("lineSep", crlf).text(path)


def _fields(raw: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Header fields and the length of the header behind a magic; None if it is no header."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    out = {}
    for line in raw[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().lower()] = value.strip()
    if not out.get(b"content-length", b"").isdigit() or b"warc-type" not in out:
        return None
    return out, end + 4


SEGMENT = ("file string, block long, at long, size long, next long, exit long, kind string, page_id long, "
           "payload_bytes long, payload_digest string, refers_to long, whole boolean, read_bytes long, "
           "read_digest string, head_at int")


def _digest(payload: bytes) -> str:
    import base64
    import hashlib
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _parse(batches):
    """One row per piece of file between two magics. Offsets count from the split's first
    piece; ``next`` is the successor a candidate names, ``exit`` where its chain
    leaves the split."""
    import pyarrow as pa
    names = [x.strip().split()[0] for x in SEGMENT.split(",")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    kinds = [types[x.strip().split()[1]] for x in SEGMENT.split(",")]
    rows, split, at = [], None, 0

    def ended():
        known = {r[2]: r for r in rows if r[4] is not None}
        for start in sorted(known, reverse=True):
            r = known[start]
            r[5] = known[r[4]][5] if r[4] in known else r[4]
        for i in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 5000]), kinds)], names)
    for batch in batches:
        for raw, file, block in zip(batch.column("value"), batch.column("file").to_pylist(),
                                    batch.column("block").to_pylist()):
            if (file, block) != split:
                yield from ended()
                rows, split, at = [], (file, block), 0
            raw = raw.as_py() or b""
            row = [file, block, at, len(raw), None, None, None, None, None, None, None, None, None, None, None]
            if found := _fields(raw):
                f, head = found
                n = int(f[b"content-length"])
                row[4] = at + head + n + 4 + len(MAGIC)  # where the next piece starts
                number = lambda k: int(f[k]) if f.get(k, b"").lstrip(b"-").isdigit() else None
                digest = f.get(b"warc-payload-digest", b"").decode().partition(":")[2]
                row[6:11] = [f[b"warc-type"].decode("utf-8", "replace"), number(b"x-page-id"),
                             number(b"x-payload-length"), digest, number(b"x-refers-to-page-id")]
                row[11], row[14] = head + n <= len(raw), head
                if row[11]:
                    block_bytes = raw[head:head + n]
                    body = block_bytes.find(b"\r\n\r\n") + 4
                    payload = block_bytes[body:] if body > 3 else block_bytes
                    row[12], row[13] = len(payload), _digest(payload)
            rows.append(row)
            at += len(raw) + len(MAGIC)
    yield from ended()


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block")))


def verified_records(spark: SparkSession, path: str) -> DataFrame:
    """The records reachable from each file's start: (file, start, kind, page_id,
    payload_bytes, payload_digest, refers_to, read_bytes, read_digest), where read_*
    describe the payload as read. Works for any number of splits per file."""
    segs = cut(_segments(spark, path).mapInArrow(_parse, SEGMENT))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = (segs.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("_n"))
            .withColumn("base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    pieces = cut(segs.join(base, ["file", "block"]).withColumns({
        "start": F.col("base") + F.col("at"), "next": F.col("base") + F.col("next"),
        "exit": F.col("base") + F.col("exit")}))
    jumps = pieces.where("exit is not null").select("file", F.col("start").alias("u"), F.col("exit").alias("v"))
    first = len(MAGIC)  # the piece before a file's first magic is empty
    entered = pieces.where(F.col("start") == first).select("file", F.lit(first).cast("long").alias("u")).distinct()
    # only places that some chain enters matter between splits
    targets = jumps.select("file", F.col("v").alias("u")).union(entered).distinct()
    jumps = cut(jumps.join(targets, ["file", "u"], "left_semi"))
    entered, seen = cut(entered), 0
    while (n := entered.count()) > seen:
        seen = n
        hops = entered.join(jumps, ["file", "u"]).select("file", F.col("v").alias("u"))
        known = pieces.select("file", F.col("start").alias("u"))
        entered = cut(entered.union(hops.join(known, ["file", "u"], "left_semi")).distinct())
        after = jumps.select("file", F.col("u").alias("v"), F.col("v").alias("w"))
        jumps = cut(jumps.join(after, ["file", "v"], "left").select("file", "u", F.coalesce("w", "v").alias("v")))
    marked = (pieces.join(entered.withColumn("entry", F.lit(True)).withColumnRenamed("u", "start"),
                          ["file", "start"], "left")
              .select("file", "block", "start", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
              .groupBy("file", "block").applyInArrow(_follow, "file string, start long, record boolean"))
    owner = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    pieces = cut(pieces.join(marked, ["file", "start"]).withColumn(
        "owner", F.last(F.when(F.col("record"), F.struct("start", "whole")), ignorenulls=True).over(owner)))
    cols = ["file", "start", "kind", "page_id", "payload_bytes", "payload_digest", "refers_to"]
    plain = pieces.where("record and whole").select(*cols, "read_bytes", "read_digest")
    split = pieces.where("not owner.whole")
    if split.isEmpty():
        return plain
    raw = _segments(spark, path).mapInArrow(_raw, "file string, block long, at long, value binary")
    joined = (split.select("file", "block", "at", "start", "next", "head_at", "record", F.col("owner.start").alias("own"))
              .join(raw, ["file", "block", "at"]).groupBy("file", "own")
              .applyInArrow(_join_pieces, "file string, start long, read_bytes long, read_digest string"))
    return plain.union(split.where("record").select(*cols).join(joined, ["file", "start"])
                       .select(*cols, "read_bytes", "read_digest"))


def _follow(table):
    """Records of one split: everything on a chain from an entered place."""
    import pyarrow as pa
    start, nxt = table.column("start").to_pylist(), table.column("next").to_pylist()
    known = dict(zip(start, nxt))
    marked = set()
    for s, e in zip(start, table.column("entry").to_pylist()):
        while e and s in known and s not in marked and known[s] is not None:
            marked.add(s)
            s = known[s]
    return pa.table({"file": table.column("file"), "start": table.column("start"),
                     "record": pa.array(np.array([s in marked for s in start], bool))})


def _raw(batches):
    import pyarrow as pa
    split, at = None, 0
    for batch in batches:
        places = []
        for n, file, block in zip(batch.column("value"), batch.column("file").to_pylist(),
                                  batch.column("block").to_pylist()):
            if (file, block) != split:
                split, at = (file, block), 0
            places.append(at)
            at += len(n.as_buffer() if n.is_valid else b"") + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(places, pa.int64()),
                                          batch.column("value")], ["file", "block", "at", "value"])


def _join_pieces(key, table):
    """One record whose payload holds magics: its pieces in order, at most a record long."""
    import pyarrow as pa
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("start", "value", "next", "head_at", "record"))))
    start, _, nxt, head, _ = rows[0]
    raw = MAGIC.encode().join(r[1] or b"" for r in rows)
    block = raw[head:nxt - start - 4 - len(MAGIC)]
    body = block.find(b"\r\n\r\n") + 4
    payload = block[body:] if body > 3 else block
    return pa.table({"file": [key[0].as_py()], "start": pa.array([start], pa.int64()),
                     "read_bytes": pa.array([len(payload)], pa.int64()), "read_digest": [_digest(payload)]})


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as an archive and return the records read back, with ``intact``:
    the payload read has the digest its header states (true for revisits)."""
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(archive_records(pages, min_bytes), path)
    rec = verified_records(spark, path)
    rev = F.col("kind") == "revisit"
    return rec.select(
        "page_id", F.when(rev, F.col("payload_bytes")).otherwise(F.col("read_bytes")).alias("payload_bytes"),
        F.when(rev, F.col("payload_digest")).otherwise(F.col("read_digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to",
        (rev | (F.col("payload_digest") == F.col("read_digest"))).alias("intact"))


def op10(pages: DataFrame) -> DataFrame:
    return round_trip(pages)


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS intact FROM d
"""
