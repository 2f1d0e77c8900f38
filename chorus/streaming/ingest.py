"""S1 and S2 as file streams: landed JSON documents become posts as they arrive, documents
that cannot be read go to a quarantine, and an id that was seen before adds nothing.

The ids are kept in the stream's state, so a rerun or a later file with the same posts
adds no row. A document counts as broken if its text is no JSON, does not fit the schema or
has no list of posts; its text is kept as it came. Both outputs have one folder
per epoch, which a replayed epoch overwrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.sources import landed as L
from chorus.streaming.daily import run_stream

BAD = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def _stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, schema: str, parts: Callable[[Column], Column],
            key: Callable[[Column], Column], finish: Callable[[DataFrame], DataFrame], files_per_trigger: int):
    """``parts``: the array of posts of a parsed document; ``key``: the id of one of them;
    ``finish``: post records of rows with the part as ``c``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(source_dir)
    docs = lines.select("value", F.from_json("value", schema + ", _bad string", BAD).alias("doc"))
    docs = docs.select("value", parts(F.col("doc")).alias("parts"), F.col("doc._bad").isNotNull().alias("bad"))
    broken = F.col("bad") | F.col("parts").isNull()
    none = F.get(F.col("parts"), F.size("parts"))  # NULL of the part's type
    rows = docs.select(F.explode(F.when(broken, F.array(F.struct(none.alias("c"), F.col("value").alias("raw")))).otherwise(
        F.transform("parts", lambda p: F.struct(p.alias("c"), F.lit(None).cast("string").alias("raw"))))).alias("r")).select("r.*")
    # a post without an id is told apart by its content
    seen = F.coalesce(F.concat(F.lit("id:"), key(F.col("c"))), F.concat(F.lit("raw:"), F.sha2(F.col("raw").cast("binary"), 256)),
                      F.concat(F.lit("part:"), F.sha2(F.to_json(F.struct("c")).cast("binary"), 256)))
    new = rows.withColumn("seen", seen).dropDuplicates(["seen"])

    def sink(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()  # both outputs come from one run of the batch
        try:
            finish(batch.where(F.col("raw").isNull()).select("c")).write.mode("overwrite").parquet(f"{out_dir}/posts/epoch={epoch}")
            batch.where(F.col("raw").isNotNull()).select("raw").write.mode("overwrite").parquet(f"{out_dir}/broken/epoch={epoch}")
        finally:
            batch.unpersist()
    run_stream(new, sink, checkpoint, "append")
    return (spark.read.parquet(f"{out_dir}/posts").drop("epoch"),
            spark.read.parquet(f"{out_dir}/broken").drop("epoch"))


def stream_listing_posts(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, files_per_trigger: int = 1000):
    """S1 over what has landed since the last run: (posts so far, broken documents so far)."""
    return _stream(spark, source_dir, out_dir, checkpoint, L.LISTING_SCHEMA, lambda d: d["data"]["children"],
                   lambda c: c["data"]["id"], lambda rows: L.listing_posts(L.listing_children(rows)), files_per_trigger)


def stream_hits_posts(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, files_per_trigger: int = 1000):
    """S2 over what has landed since the last run: (posts so far, broken documents so far)."""
    return _stream(spark, source_dir, out_dir, checkpoint, "hits array<string>", lambda d: d["hits"],
                   lambda c: F.get_json_object(c, "$.objectID"),
                   lambda rows: L.hit_posts(rows.select(F.col("c").alias("h"))), files_per_trigger)
