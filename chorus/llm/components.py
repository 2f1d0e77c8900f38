"""Connected components as joins and aggregates (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b), a <> b; component is the
    smallest node of its connected component.

    Each round hangs every node's larger neighbours under its smallest one and then
    its smaller neighbours likewise. A node with very many links costs a partial
    ``min`` and a join that AQE can split; nothing is gathered per node. Rounds end
    when the links are a star around every component's smallest node; each round is
    written to the checkpoint folder and only its row count and digest reach the driver."""
    def digest(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    edges = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
                .where("v <> u").distinct())
    seen = digest(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = cut(large.where("v <> u").distinct())
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(low, "v")
        small = joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(
            low.select("v", F.col("m").alias("u")))
        edges = cut(small.where("v <> u").distinct())
        now = digest(edges)
        if now == seen:
            break
        seen = now
    stars = edges.groupBy("v").agg(F.min("u").alias("component"))
    return stars.select(F.col("v").alias("node"), "component")
