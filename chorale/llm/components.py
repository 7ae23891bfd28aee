"""Connected components of links between long ids, by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """`links` (a, b) to (node, root): the smallest id reachable, for every id in a link with another id.

    Every step keeps one row per link at most, groups with map-side minima and cuts the lineage by a checkpoint; the number of
    steps grows with the logarithm of the longest path. Nothing is collected but a count and a checksum.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = cut_lineage(edges), None
    while True:
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.union(low.toDF("a", "b")).distinct())
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.toDF("node", "root").union(roots)
