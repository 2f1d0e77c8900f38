"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of a source are ordered by a seeded hash (the shuffle) and ranked; a row's
fractional rank is (rank + 1/2) / rows of its source. All rows sorted by
fractional rank interleave the sources in proportion, and consecutive cuts of
equal length are the shards: every shard holds each source's share of the
mixture to within a row or two, and shard counts differ by one at most.

Both rankings are distributed prefix sums over hash or fraction buckets, so a
source with a third of all rows spreads over as many tasks as it has buckets."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import bucket_sums, hash_key, key_bucket, running_sum, source_key


def interleave_shards(docs: DataFrame, n_shards: int = 40, seed: int = 17,
                      carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all of ``docs``) plus ``shard`` int and ``slot`` long.

    ``docs`` needs doc_id, text and source. Defined cases: a null source is a
    stratum of its own; null ids and texts hash as such; equal rows are
    interchangeable and take neighbouring places; an empty table gives no rows;
    columns of the input named shard or slot are replaced, and so are the
    working names, which start with ``_il_``."""
    carry = docs.columns if carry is None else carry
    kept = [c for c in carry if c not in ("shard", "slot")]
    n = docs.count()
    nb = max(1, isqrt(n))  # as many buckets as rows in one
    df = docs.select(*kept, source_key(F.col("source")).alias("_il_src"),
                     hash_key(seed, F.col("doc_id"), F.md5(F.col("text").cast("binary"))).alias("_il_key"))
    df = df.withColumn("_il_b", key_bucket(F.col("_il_key"), nb))
    one = F.lit(1).cast("long")
    per = bucket_sums(df, ["_il_src"], "_il_b", one)
    df = running_sum(df, ["_il_src"], "_il_b", [F.col("_il_key")], one, "_il_rank", per)
    strata = per.groupBy("_il_src").agg(F.sum("_rows").alias("_il_n"))
    df = df.join(strata, "_il_src").withColumn("_il_f", (F.col("_il_rank") + 0.5) / F.col("_il_n"))
    df = df.withColumn("_il_b", F.floor(F.col("_il_f") * nb))
    df = running_sum(df, [], "_il_b", [F.col("_il_f"), F.col("_il_src"), F.col("_il_rank")], one, "_il_pos")
    shard = F.expr(f"(_il_pos * {n_shards}L) div {max(n, 1)}L")
    first = F.expr(f"(shard * {max(n, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return (df.withColumn("shard", shard).withColumn("slot", F.col("_il_pos") - first)
            .select(*kept, F.col("shard").cast("int").alias("shard"), "slot"))


def op3(docs: DataFrame) -> DataFrame:
    """Contract columns: law ``rows`` (counts at most one apart)."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select("doc_id", "text", "source", (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    out = interleave_shards(rows, 40, carry=["doc_id", "size", "text_crc32"])  # the text itself stays behind
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
