"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges a and b (long): label is the smallest node that it can reach.

    Alternates large-star and small-star steps until the edges no longer change; each round is written to the shared
    folder, so a lost executor costs that round at most. Nodes without an edge to another node don't appear.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mine = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mine, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(mine.select("a", F.col("m").alias("b")))
        after = written(small.distinct(), "edges")
        seen, mark = mark, _mark(after)
        remove(now)
        now = after
        if mark == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
