"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source, rows are ordered by that key
(range buckets of the key, then a sort inside the bucket), a distributed prefix
sum of sizes gives each row its place in the source, and the source's exact
budget cuts there: whole epochs first, then the part of one more epoch that the
budget still allows. The row on the cut is taken in part."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import bucket_sums, cut, hash_key, key_bucket, n_words, running_sum, source_key

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(_src, source_size, target) from (_src, source_size): weights repeat over the
    sources in code point order (null last); a target stops at ``max_epochs`` times
    the source's size, and the excess is shared among the others by weight until no
    target is above its stop.

    The level ``v`` with target = min(stop, v * weight) rises round by round; a
    round is one aggregate over the sources, of which two numbers reach the driver."""
    k = len(weights)
    # null ("n") sorts last, the others by UTF-8 bytes, which is code point order
    order = Window.orderBy((F.col("_src") == "n").cast("int"), "_src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % k + 1).cast("int"))
    src = cut(sizes.withColumn("_rank", F.row_number().over(order) - 1)
              .withColumn("_w", w).withColumn("_stop", F.col("source_size") * float(max_epochs)))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while total:
        full = F.col("_stop") <= F.lit(level) * F.col("_w")
        n, used, free = src.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("_stop"))), F.lit(0.0)),
                                F.sum(F.when(~full, F.col("_w")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (total - used) / free
    return src.select("_src", "source_size", F.least("_stop", F.lit(level) * F.col("_w")).alias("target"))


def mix_to_weights(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
                   seed: int = 23, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all of ``docs``) plus size, source_size, target, taken.

    ``size`` defaults to the number of words. Defined cases: a null text has size
    0 and takes 0; a null source is the last source; equal rows are
    interchangeable, one of them may be taken once more than the other; a source
    whose texts are all empty has target 0; an empty table gives no rows; input
    columns named like the results or ``_mx_*`` are replaced."""
    new = ("size", "source_size", "target", "taken")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in new]
    light = size is None and set(kept) <= {"doc_id", "source"}
    df = docs.select(*kept, source_key(F.col("source")).alias("_mx_src"),
                     hash_key(seed, F.col("doc_id"), F.md5(F.col("text").cast("binary"))).alias("_mx_key"),
                     (n_words(F.col("text")) if size is None else size.cast("long")).alias("size"))
    if light:
        df = cut(df)  # words are counted once
    nb = max(1, isqrt(docs.count()))  # as many buckets as rows in one
    df = df.withColumn("_mx_b", key_bucket(F.col("_mx_key"), nb))
    per = bucket_sums(df, ["_mx_src"], "_mx_b", F.col("size"))
    targets = source_targets(per.groupBy(F.col("_mx_src").alias("_src")).agg(F.sum("_sum").alias("source_size")),
                             weights, max_epochs)
    df = running_sum(df, ["_mx_src"], "_mx_b", [F.col("_mx_key"), F.col("size")], F.col("size"), "_mx_at", per)
    df = df.join(targets.withColumnRenamed("_src", "_mx_src"), "_mx_src")
    budget = F.floor(F.col("target") + 1e-6)
    epochs = F.expr("cast(floor(target + 1e-6) as bigint) div source_size")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_mx_at")))
    taken = F.when(F.col("source_size") > 0, epochs * F.col("size") + part).otherwise(0).cast("long")
    return df.select(*kept, "size", "source_size", "target", taken.alias("taken"))


def take_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents the mix holds: ``taken div size`` whole copies, and for the row on
    the cut one more copy with the first ``taken mod size`` words (joined by one space)."""
    n, r = F.expr("taken div size"), F.expr("taken % size")
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    copies = mixed.where("size > 0 and taken > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), (n + (r > 0).cast("long")).cast("int"))))
    part = F.col("_copy") > n
    text = F.when(part, F.array_join(F.slice(words, 1, r.cast("int")), " ")).otherwise(F.col("text"))
    out = copies.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(part, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def op6(docs: DataFrame) -> DataFrame:
    """Contract columns over all documents."""
    return mix_to_weights(docs, carry=["doc_id"])


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         substr(md5('23|' || coalesce(CAST(doc_id AS VARCHAR), chr(0)) || '|' || coalesce(md5(text), chr(0))), 1, 15) AS k0
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
             source_size * 3.0::DOUBLE AS stop FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all,
             coalesce(sum(stop) OVER o, 0) AS stop_before, coalesce(sum(w) OVER o, 0) AS w_before
      FROM r WINDOW o AS (ORDER BY stop / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min_by((total - stop_before) / (w_all - w_before), stop / w) AS level
      FROM c WHERE stop / w >= (total - stop_before) / (w_all - w_before)),
t AS (SELECT source, source_size, least(stop, w * level) AS target FROM r, v),
k AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 1e-6) AS BIGINT) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k0, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN CAST(budget // source_size * size
         + greatest(0, least(size, budget % source_size - pos0)) AS BIGINT) ELSE 0 END AS taken
FROM k
"""
