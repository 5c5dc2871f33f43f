"""Connected components by alternating star contraction, each round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.sources.storage import discard, stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, label) of all ids in links (a, b): the smallest id connected with each. Fails if it has not settled in max_rounds."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == mark or not now[0]:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        old, edges = edges, stored(small.distinct(), "edges")
        discard(old)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
